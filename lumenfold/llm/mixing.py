"""Mixing sources to target weights by pivotal dependent rounding. DataFrame functions only.

A source of ``source_size`` words with target ``t`` needs ``t / source_size`` copies
of each document. The whole part is taken outright. The fractional part is settled by
duels: two documents exchange words until the copies of one are whole. Up and down
moves are drawn so that each document's expected copies stay what they were, and
every duel leaves the words of the pair unchanged.

Duels form a reduction tree. Documents fall into leaves of about ``LEAF`` by a hash
of source and document; a leaf settles all but one of its documents and sends that
residual up, where residuals meet in groups of ``LEAF`` again. Each level holds
1/LEAF of the rows of the one below, a source that has a third of all rows is spread
over its many leaves, and at the root each source has one residual left, which goes to
the nearer whole number. What that leaves over or short is settled by further transfers between whole numbers
next to the source's rate, the document whose size is closest first, until every
source is within ``CLOSE`` of its target (large sources are so already). Copies of a document never leave
the two whole numbers around its source's rate.

Defined results
* null or empty text: size 0, never in a duel, ``taken`` 0.
* null source: a source of its own, last in the order of sources.
* all sizes 0, or an empty table: targets 0 and nothing taken.
* rows that repeat: each row is mixed by itself. Ids may be null or repeat: leaves go by id and text, and where a
  row repeats more than ``LEAF`` times its repeats are dealt over leaves of their own.
* draws come from hashes of ids and texts, so reruns and other partitionings agree (but for which of many equal rows is taken).
* extra columns: not carried; a name such as ``size`` in the input does no harm.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, keep, row_key

#: Documents that meet in one group of the tree, on average.
LEAF = 48
#: A document is repeated this often at most.
MOST_COPIES = 3
#: Share of its target by which a source may be off without a last exchange, and rounds of exchanges.
CLOSE, ROUNDS = 0.005, 10
#: Documents on each side that are looked at as pairs in one.
PAIRS = 64
#: Weights that sources get in turn.
WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(values: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rank 0, 1, 2... in a total order, without one task that sees all rows.

    Rows are range-partitioned and numbered in their partition; only the sizes of
    partitions, as many as there are partitions, are summed up.
    """
    placed = values.repartitionByRange(values.sparkSession.sparkContext.defaultParallelism, *order).sortWithinPartitions(*order)
    placed = keep(placed.withColumn("_id", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND((1 << 33) - 1)})
    sizes = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for part in sorted(sizes):
        before += [F.lit(part), F.lit(total)]
        total += sizes[part]
    start = F.create_map(*before)[F.col("_part")] if before else F.lit(0)
    return placed.withColumn(name, (start + F.col("_at")).cast("long")).drop("_id", "_part", "_at")


def source_targets(sized: DataFrame, weights=WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """source, source_size, target. ``sized`` has source and size.

    The water level rises until no source is above ``most`` times its size; each
    round is one aggregate over sources, and the level never falls.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = ranked(sums, [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", weight)
    roof = F.col("source_size").cast("double") * most
    total = by.agg(F.sum("source_size")).first()[0] or 0
    level, met = 0.0, -1
    while total:
        over = F.col("weight") * F.lit(level) >= roof
        got = by.agg(F.sum(F.when(over, roof)).alias("full"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("open"), F.count_if(over).alias("n")).first()
        if got["n"] == met or not got["open"]:
            break
        met, level = got["n"], (total - (got["full"] or 0.0)) / got["open"]
    out = by.select("source", "source_size", F.least(F.col("weight") * F.lit(level), roof).alias("target"))
    return out


def _unit(*keys: Column) -> Column:
    """A uniform number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") / F.lit(float(1 << 53))


_ITEM = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", T.LongType()), T.StructField("key", T.LongType()), T.StructField("size", T.LongType()), T.StructField("base", T.LongType()), T.StructField("p", T.DoubleType())])
_ACC = T.StructType([T.StructField("done", T.ArrayType(_ITEM)), T.StructField("cur", _ITEM)])


def _with(item: Column, p: Column) -> Column:
    return F.struct(item["row"].alias("row"), item["id"].alias("id"), item["key"].alias("key"), item["size"].alias("size"), item["base"].alias("base"), p.alias("p"))


def _let(value: Column, body) -> Column:
    """``body`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _duel(acc: Column, x: Column, seed: int) -> Column:
    """Settle one of acc.cur and x; the other goes on as acc.cur."""
    c, s_c, s_x = acc["cur"], acc["cur"]["size"].cast("double"), x["size"].cast("double")
    room = F.struct(
        ((1 - c["p"]) * s_c).alias("c_up"), (c["p"] * s_c).alias("c_down"), (x["p"] * s_x).alias("x_down"), ((1 - x["p"]) * s_x).alias("x_up"), _unit(c["key"], x["key"], F.lit(seed)).alias("u"),
    )

    def moved(r: Column) -> Column:
        up, down = F.least(r["c_up"], r["x_down"]), F.least(r["c_down"], r["x_up"])
        c_full, c_none = r["c_up"] <= r["x_down"], r["c_down"] <= r["x_up"]
        rise = r["u"] * (up + down) < down
        high = F.struct(F.when(c_full, 1.0).otherwise(c["p"] + up / s_c).alias("c"), F.when(r["x_down"] <= r["c_up"], 0.0).otherwise(x["p"] - up / s_x).alias("x"))
        low = F.struct(F.when(c_none, 0.0).otherwise(c["p"] - down / s_c).alias("c"), F.when(r["x_up"] <= r["c_down"], 1.0).otherwise(x["p"] + down / s_x).alias("x"))
        return F.when(rise, high).otherwise(low)

    def settled(m: Column) -> Column:
        c_done = (m["c"] <= 0.0) | (m["c"] >= 1.0)
        x_done = (m["x"] <= 0.0) | (m["x"] >= 1.0)
        c_new, x_new = _with(c, m["c"]), _with(x, m["x"])
        none = F.lit(None).cast(_ITEM)
        out = F.when(c_done & x_done, F.array(c_new, x_new)).when(c_done, F.array(c_new)).otherwise(F.array(x_new))
        return F.struct(F.concat(acc["done"], out).alias("done"), F.when(c_done & x_done, none).when(c_done, x_new).otherwise(c_new).alias("cur")).cast(_ACC)

    return _let(_let(room, moved), settled)


def _level(items: DataFrame, seed: int) -> DataFrame:
    """One level: groups of (source, leaf) -> settled items and one residual each."""
    zero = F.struct(F.array().cast(T.ArrayType(_ITEM)).alias("done"), F.lit(None).cast(_ITEM).alias("cur")).cast(_ACC)

    def step(acc: Column, x: Column) -> Column:
        return F.when(acc["cur"].isNull(), F.struct(acc["done"].alias("done"), x.alias("cur")).cast(_ACC)).otherwise(_duel(acc, x, seed))

    rows = F.sort_array(F.collect_list(F.struct("size", F.xxhash64("key", F.lit(seed)).alias("h"), F.struct("row", "id", "key", "size", "base", "p").cast(_ITEM).alias("item"))), asc=False)
    got = items.groupBy("source", "source_size", "target", "leaf").agg(rows.alias("rows"))
    return got.select("source", "source_size", "target", F.aggregate(F.transform("rows", lambda r: r["item"]), zero, step).alias("acc"))


def _out(each: DataFrame, may_rise: int = 1) -> DataFrame:
    """Rows with item and whole copies -> the result's columns. open: whether one copy more is next to the rate too."""
    item = F.col("item")
    return each.select(item["row"].alias("row"), item["id"].alias("doc_id"), item["key"].alias("key"), item["size"].alias("size"), "source", "source_size", "target", item["base"].alias("base"), F.lit(may_rise).alias("open"), (item["base"] + F.round(item["p"]).cast("long")).alias("copies"))


def _last_exchange(mixed: DataFrame) -> DataFrame:
    """In each source that is off, one document gives up a copy, or another gains one, or both, whatever comes closest.

    Copies stay the whole numbers around the source's rate. A single document is looked for among all of the source,
    a pair among ``PAIRS`` documents of each side: in a source with more documents a single one is close enough.
    """
    off = F.sum(F.col("size") * F.col("copies")) - F.max("target")
    sums = mixed.groupBy("source").agg(off.alias("off"), F.max("target").alias("_t")).select(F.col("source").alias("_source"), "off", "_t")
    sums = sums.filter(F.abs("off") > CLOSE * F.col("_t"))
    gives, gains = F.col("copies") > F.col("base"), F.col("copies") < F.col("base") + F.col("open")
    near = mixed.join(sums, F.col("source").eqNullSafe(F.col("_source"))).filter((F.col("size") > 0) & (gives | gains))
    near = near.select("source", "off", "row", "size", F.xxhash64("key").alias("h"), gives.alias("gives"))
    single = F.struct(F.abs(F.col("off") - F.when(F.col("gives"), F.col("size")).otherwise(-F.col("size"))).alias("gap"), "h", F.when(F.col("gives"), F.col("row")).alias("less"), F.when(~F.col("gives"), F.col("row")).alias("more"))
    singles = near.groupBy("source", "off").agg(F.min(single).alias("m"))
    few = near.withColumn("k", F.row_number().over(Window.partitionBy("source", "gives").orderBy("h", "row"))).filter(F.col("k") <= PAIRS)
    side = lambda given: F.collect_list(F.when(F.col("gives") == given, F.struct("size", "row")))
    lists = few.groupBy("source", "off").agg(side(True).alias("d"), side(False).alias("u"))
    gap = lambda a, b: F.abs(F.col("off") - a["size"] + b["size"])
    each = F.flatten(F.transform("d", lambda a: F.transform(F.col("u"), lambda b: F.struct(gap(a, b).alias("gap"), F.lit(0).cast("long").alias("h"), a["row"].alias("less"), b["row"].alias("more")))))
    pairs = lists.select("source", "off", F.array_min(each).alias("m")).filter("m is not null")
    best = singles.unionByName(pairs).groupBy("source", "off").agg(F.min("m").alias("m")).filter(F.col("m.gap") < F.abs("off"))
    moves = best.select(F.explode(F.array(F.struct(F.col("m.less").alias("row"), F.lit(-1).alias("more")), F.struct(F.col("m.more").alias("row"), F.lit(1).alias("more")))).alias("x")).select("x.*").filter("row is not null")
    return mixed.join(moves, "row", "left").withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0))).drop("more")


def _spread_repeats(sized: DataFrame) -> DataFrame:
    """``key`` of rows that repeat more than LEAF times takes in the row, so that no leaf gathers them."""
    often = sized.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > LEAF).select(F.col("key").alias("_often"))
    often = keep(often, "often")
    if often.isEmpty():
        return sized
    key = F.when(F.col("_often").isNotNull(), F.xxhash64("key", "row")).otherwise(F.col("key"))
    return keep(sized.join(often, F.col("key") == F.col("_often"), "left").withColumn("key", key).drop("_often"), "sized")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most: int = MOST_COPIES, seed: int = 1) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken: how often the mix takes each row."""
    sized = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), row_key(F.col(id_col), F.xxhash64(text_col)).alias("key"))
    sized = _spread_repeats(keep(sized.withColumn("row", F.monotonically_increasing_id()), "sized"))
    targets = keep(source_targets(sized.select("source", "size"), weights, most), "targets")
    # AQE broadcasts the source table when its measured size allows that, and splits a hot source when not.
    rated = sized.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.least(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)), F.lit(float(most)))
    whole = F.floor(rate + 1e-12)
    left = F.greatest(rate - whole, F.lit(0.0))
    fights = (F.col("size") > 0) & (left > 1e-12)
    rated = keep(rated.select("row", "id", "key", "source", "source_size", "target", "size", whole.alias("base"), F.when(fights, left).otherwise(0.0).alias("p")), "rated")
    calm = _out(rated.filter("p = 0").select("source", "source_size", "target", F.struct("row", "id", "key", "size", "base", "p").alias("item")), 0)
    counts = rated.filter("p > 0").groupBy("source").agg(F.count("*").alias("n"))
    most_rows = counts.agg(F.max("n")).first()[0] or 0
    parts, spent = [calm], [sized]
    items = rated.filter("p > 0")
    level = 0
    while most_rows:
        leaves = math.ceil(most_rows / LEAF)
        if leaves > 1:
            sizes = keep(items.groupBy("source").agg(F.ceil(F.count("*") / LEAF).cast("long").alias("_leaves")), "leaves")
            spent.append(sizes)
            items = items.join(sizes.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
            items = items.withColumn("leaf", F.pmod(F.xxhash64("key", F.lit(seed * 1000 + level)), F.col("_leaves")))
        else:
            items = items.withColumn("leaf", F.lit(0).cast("long"))
        fought = keep(_level(items, seed * 1000 + level), f"level{level}")
        parts.append(_out(fought.select("source", "source_size", "target", F.explode("acc.done").alias("item"))))
        rest = fought.filter("acc.cur is not null").select("source", "source_size", "target", F.col("acc.cur").alias("item"))
        if leaves == 1:
            parts.append(_out(rest))
            break
        items = rest.select("source", "source_size", "target", "item.*")
        most_rows = items.groupBy("source").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        level += 1
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    mixed = keep(out, "mixed")
    drop(*spent, targets)
    for _ in range(ROUNDS):
        off = mixed.groupBy("source").agg((F.sum(F.col("size") * F.col("copies")) - F.max("target")).alias("off"), F.max("target").alias("t"))
        if off.filter(F.abs("off") > CLOSE * F.col("t")).isEmpty():
            break
        settled = keep(_last_exchange(mixed), "settled")
        drop(mixed)
        mixed = settled
    return mixed.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))

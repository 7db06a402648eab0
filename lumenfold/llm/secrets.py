"""Secret scans with corpus-wide ownership frequency. DataFrame functions only.

Base patterns give candidates. Each candidate's value is hashed, and hashes are
counted over the whole corpus by distinct owners and repositories. A value that many
owners have, or that sits in many repositories, is an example that was copied around. One that a single owner has in
few repositories, and that looks random, is a live-looking credential and gets a further span ``live``.
What lies between is neither.

Counting aggregates (hash, owner, repository) before every shuffle, so a value that
a third of all documents hold is a few rows when it moves. Texts never move: spans
are taken in the scan, and only spans with their hashes are joined.

Defined results
* null or empty text: no spans, digest of the empty string.
* null source: an owner of its own.
* rows that repeat: each row has its own result.
* spans are counted in code points, end exclusive; kinds may overlap each other.
* empty table: no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, keep

#: The base patterns, in the order in which kinds are listed.
ASSIGN = r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
ASSIGN_VALUE = r"[A-Za-z0-9+/_.=-]+"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "live")

#: From so many owners or repositories on, a value counts as an example; a live-looking one is in so many repositories at most.
EXAMPLE_OWNERS, EXAMPLE_REPOS, LIVE_REPOS = 3, 6, 2
#: A live-looking value has at least so many different characters.
LIVE_DISTINCT = 8

SPAN = "struct<start:int,end:int,v_start:int,hash:bigint,random:boolean>"


def _spans(text: Column, kind: str) -> Column:
    """array<SPAN> of one kind. Matches chain from the end of the one before, so a text is read once."""
    if kind == "assign":
        head, value, guard = f"(?i:{ASSIGN})", ASSIGN_VALUE, text.rlike(f"(?i:{ASSIGN}){ASSIGN_VALUE}")
    elif kind == "access":
        head, value, guard = "", ACCESS, text.contains("AKIA")
    else:
        # A maximal run of 16 or more is what is left of all runs once shorter ones are dropped.
        head, value, guard = "", "[0-9a-f]{16,}", text.rlike("[0-9a-f]{16}")
    pattern = F.lit(rf"\G(?s:(.*?))({head})({value})")
    gap, lead, got = (F.regexp_extract_all(text, pattern, F.lit(i)) for i in (1, 2, 3))
    parts = F.zip_with(F.zip_with(gap, lead, lambda g, h: F.struct(F.char_length(g).alias("g"), F.char_length(h).alias("h"))), got, lambda a, v: F.struct(a["g"].alias("g"), a["h"].alias("h"), v.alias("v")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + m["g"]
        end = start + m["h"] + F.char_length(m["v"])
        random = (F.size(F.array_distinct(F.split(m["v"], ""))) >= LIVE_DISTINCT) & m["v"].rlike("[0-9]") & m["v"].rlike("[A-Za-z]")
        span = F.struct(start.alias("start"), end.alias("end"), (start + m["h"]).alias("v_start"), F.xxhash64(m["v"]).alias("hash"), random.alias("random")).cast(SPAN)
        return F.struct(end.alias("at"), F.when(F.char_length(m["v"]) >= LEAST[kind], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    none = F.array().cast(f"array<{SPAN}>")
    return F.when(guard, F.aggregate(parts, zero, step, lambda acc: acc["out"])).otherwise(none)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None) -> DataFrame:
    """row, doc_id, owner, repo and the base spans of each text, kept: the texts are read once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    repo = F.col(repo_col) if repo_col else F.col(owner_col)
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(owner_col).cast("string").alias("owner"), repo.cast("string").alias("repo"), *[_spans(text, k).alias(k) for k in KINDS[:3]])
    return keep(found.withColumn("row", F.monotonically_increasing_id()), "secrets")


def ownership(found: DataFrame) -> DataFrame:
    """hash, owners, repos: distinct owners and repositories of every candidate value, over all documents."""
    each = found.select("owner", "repo", F.explode(F.concat(*KINDS[:3])).alias("s")).select("owner", "repo", "s.hash")
    places = each.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    owners = places.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    return owners.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))


def classify(found: DataFrame) -> DataFrame:
    """row, spans: base spans, and ``live`` spans for values that one owner alone has in few repositories. Also ``live`` and ``copied`` spans apart."""
    shared = ownership(found)
    each = found.select("row", F.explode(F.concat(*KINDS[:3])).alias("s")).select("row", "s.*")
    own, copies = F.col("owners") == 1, (F.col("owners") >= EXAMPLE_OWNERS) | (F.col("repos") >= EXAMPLE_REPOS)
    live = each.filter("random").join(shared.filter(own & (F.col("repos") <= LIVE_REPOS)).select("hash"), "hash", "left_semi").select("row", F.lit(True).alias("live"), "v_start", "end")
    copied = each.join(shared.filter(copies).select("hash"), "hash", "left_semi").select("row", F.lit(False).alias("live"), "v_start", "end")
    marks = live.unionByName(copied).groupBy("row").agg(*[F.array_distinct(F.collect_list(F.when(F.col("live") == flag, F.struct(F.col("v_start").alias("start"), "end")))).alias(name) for flag, name in ((True, "live"), (False, "copied"))])
    none = F.array().cast("array<struct<start:int,end:int>>")
    return found.join(marks, "row", "left").withColumns({k: F.coalesce(k, none) for k in ("live", "copied")})


def _listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans by start, then kind as listed, comma-joined."""

    def of(place: int):  # one argument: a second one of the lambda would be the element's index
        return lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("kind"), s["end"].alias("end"))

    rows = F.concat(*[F.transform(k, of(i)) for i, k in enumerate(kinds)])
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(F.array_sort(rows), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(classified: DataFrame) -> DataFrame:
    """doc_id, counts of base kinds, digest of the base spans, all spans, and how many values are live or copied."""
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return classified.select("doc_id", *counts[:3], F.sha2(_listed(KINDS[:3]), 256).alias("base_sha256"), _listed(KINDS).alias("spans"), counts[3], F.size("copied").cast("long").alias("n_copied"))


def _may_match(text: Column) -> Column:
    """Whether some base pattern is in the text; a candidate never is in one where this is false."""
    some = text.rlike(f"(?i:{ASSIGN}){ASSIGN_VALUE}") | text.contains("AKIA") | text.rlike("[0-9a-f]{16}")
    return F.coalesce(some, F.lit(False))


def redact(docs: DataFrame, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: Column | None = None) -> DataFrame:
    """The same rows, with the values of all candidates masked but those of copied examples.

    Only rows with a possible candidate meet their spans again, by id and text hash; all
    others pass by and are never shuffled. A column ``n_chars`` follows the text.
    """
    names = docs.columns
    own_id, own_hash, own_cuts = (fresh_name(docs, n) for n in ("cut_id", "cut_hash", "cuts"))
    text = F.col(text_col)
    hit = _may_match(text)
    suspects = docs.filter(hit).select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("h")).alias("_key"), text.alias("text"), F.col(owner_col).alias("owner"), (F.col(owner_col) if repo_col is None else repo_col).alias("repo"))
    each = classify(scan(suspects, "_key", "text", "owner", "repo"))
    values = F.concat(*[F.transform(k, lambda s: F.struct(s["v_start"].alias("start"), s["end"].alias("end"))) for k in KINDS[:3]])
    cuts = each.select(F.col("doc_id.id").alias(own_id), F.col("doc_id.h").alias(own_hash), F.array_sort(F.array_except(values, F.col("copied"))).alias(own_cuts))
    cuts = cuts.filter(F.size(own_cuts) > 0).dropDuplicates([own_id, own_hash])
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        # A cut that starts inside the one before only extends it.
        more = F.when(c["start"] >= acc["at"], F.array(F.substring(text, acc["at"] + 1, c["start"] - acc["at"]), F.lit(mark))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(c["end"], acc["at"]).alias("at"), F.concat(acc["out"], more).alias("out"))

    masked = F.aggregate(own_cuts, zero, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.char_length(text))))
    met = docs.filter(hit).join(cuts, (F.col(id_col).eqNullSafe(F.col(own_id))) & (F.xxhash64(text) == F.col(own_hash)), "left")
    met = met.withColumn(text_col, F.when(F.col(own_cuts).isNull(), text).otherwise(masked))
    if "n_chars" in names:
        met = met.withColumn("n_chars", F.char_length(text_col).cast(docs.schema["n_chars"].dataType))
    return docs.filter(~hit).unionByName(met.select(*names))

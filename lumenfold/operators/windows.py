"""Window functions: ranks, ordinals, top-k, re-keying, z-buffers, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .settled import settled


def average_rank(rows: DataFrame, x: str, name: str, by: list[str] | None = None) -> DataFrame:
    """Rank with ties averaged, without sorting all rows in one task.

    Equal values collapse first; ranks are running counts over distinct values, which without groups are
    range-partitioned.
    """
    by = by or []
    counts = rows.groupBy(*by, x).agg(F.count("*").alias("_n"))
    if by:
        before = F.sum("_n").over(Window.partitionBy(*by).orderBy(x).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
        counts = counts.withColumn("_before", before)
    else:
        counts = running_count(counts, x, "_n", "_before")
    ranks = counts.withColumn(name, F.col("_before") + (F.col("_n") + 1) / 2.0).drop("_n", "_before")
    return rows.join(ranks, [*by, x])


def running_count(counts: DataFrame, x: str, n: str, name: str) -> DataFrame:
    """Adds the sum of ``n`` over smaller x; x is distinct. No task sees all values.

    Values are range-partitioned and summed inside their partition; the partitions' totals, a few numbers, are added up.
    """
    placed = settled(counts.repartitionByRange(x).withColumn("_part", F.spark_partition_id()))
    totals = placed.groupBy("_part").agg(F.sum(n).alias("_all"))
    starts = totals.select("_part", F.coalesce(F.sum("_all").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))  # a row a partition
    inside = F.sum(n).over(Window.partitionBy("_part").orderBy(x).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(n)
    return placed.withColumn("_in", inside).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_in")).drop("_part", "_in", "_start")


def global_quantiles(rows: DataFrame, x: str, shares: dict[str, float]) -> DataFrame:
    """One row: exact interpolated quantiles of all non-null x by name. Distinct values are counted before they move, and no task holds them all."""
    counts = rows.filter(F.col(x).isNotNull()).groupBy(F.col(x).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    placed = running_count(counts, "_v", "_n", "_before")
    total = placed.agg(F.sum("_n").alias("_total"))
    both = placed.crossJoin(F.broadcast(total))  # one row
    ends = []
    for name, share in shares.items():
        place = share * (F.col("_total") - 1)
        for end, at in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            ends.append(F.max(F.when((F.col("_before") <= at) & (at < F.col("_before") + F.col("_n")), F.col("_v"))).alias(f"{name}_{end}"))
    got = both.agg(F.max("_total").alias("_total"), *ends)
    weigh = lambda name, share: share * (F.col("_total") - 1) - F.floor(share * (F.col("_total") - 1))
    return got.select(*[(F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * weigh(n, s)).alias(n) for n, s in shares.items()])


def lower_quantile(rows: DataFrame, x: str, name: str, share: float = 0.5) -> DataFrame:
    """One row: the value at or below the quantile's place, of all non-null x. Distinct values are counted before they move."""
    counts = rows.filter(F.col(x).isNotNull()).groupBy(F.col(x).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    placed = running_count(counts, "_v", "_n", "_before")
    at = F.floor(share * (F.col("_total") - 1))
    both = placed.crossJoin(F.broadcast(placed.agg(F.sum("_n").alias("_total"))))  # one row
    return both.agg(F.max(F.when((F.col("_before") <= at) & (at < F.col("_before") + F.col("_n")), F.col("_v"))).alias(name))


def placed_by(rows: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """1-based place of each row of a report in a total order, as a viewer resorts it; say where nulls go in the order."""
    return global_rank(rows, list(order), "_place").withColumn(name, F.col("_place") + 1).drop("_place")


def ordinal(rows: DataFrame, by: list[str], *order: Column, name: str = "ordinal") -> DataFrame:
    """0-based place in a group; the order has to be total."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def best_and_runner_up(scores: DataFrame, by: list[str], option: str, score: str) -> DataFrame:
    """Best and second option, their scores and the margin; the smaller option wins a tie."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(option))
    top = scores.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= 2)
    first, second = F.col("_k") == 1, F.col("_k") == 2
    got = top.groupBy(*by).agg(F.max(F.when(first, F.col(option))).alias("best"), F.max(F.when(first, F.col(score))).alias("best_score"), F.max(F.when(second, F.col(option))).alias("second"), F.max(F.when(second, F.col(score))).alias("second_score"))
    return got.withColumn("margin", F.col("best_score") - F.col("second_score"))


def top_per_group(rows: DataFrame, by: list[str], k: int, *order: Column) -> DataFrame:
    """At most k rows of each group; planned as a limit inside each task before the shuffle."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_k") <= k).drop("_k")


def dense_rekey(rows: DataFrame, by: list[str], key: str, name: str) -> DataFrame:
    """0-based number of each distinct key in a group, in the order of keys."""
    keys = rows.select(*by, key).distinct()
    keys = keys.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(key)) - 1)
    return rows.join(keys, [*by, key])


def nearest_surface(pixels: DataFrame, by: list[str], z: str, *tie: Column) -> DataFrame:
    """The nearest row of each pixel."""
    return top_per_group(pixels, by, 1, F.asc(z), *tie)


def forward_pairs(grid: DataFrame, row: list[str], along: str, x: str, valid: str) -> DataFrame:
    """Difference to the next cell along an axis, for neighbours that are both valid."""
    w = Window.partitionBy(*row).orderBy(along)
    nxt = grid.withColumns({"_x": F.lead(x).over(w), "_v": F.lead(valid).over(w), "_a": F.lead(along).over(w)})
    return nxt.filter(F.col(valid) & F.col("_v") & (F.col("_a") == F.col(along) + 1)).withColumn("diff", F.col("_x") - F.col(x)).drop("_x", "_v", "_a")


def neighbourhood_range(grid: DataFrame, by: list[str], row: str, col: str, x: str) -> DataFrame:
    """Minimum and maximum of the 3x3 cells around each cell, edges repeated: two passes of three."""
    across = Window.partitionBy(*by, row).orderBy(col).rowsBetween(-1, 1)
    down = Window.partitionBy(*by, col).orderBy(row).rowsBetween(-1, 1)
    once = grid.withColumns({"_lo": F.min(x).over(across), "_hi": F.max(x).over(across)})
    return once.withColumns({"low": F.min("_lo").over(down), "high": F.max("_hi").over(down)}).drop("_lo", "_hi")


def depth_edges(grid: DataFrame, by: list[str], row: str, col: str, z: str, rtol: float) -> DataFrame:
    """``edge``: the depth range around a cell exceeds ``rtol`` of its depth."""
    near = neighbourhood_range(grid, by, row, col, z)
    return near.withColumn("edge", F.coalesce(F.try_divide(F.col("high") - F.col("low"), F.col(z)) > rtol, F.lit(False)))


def count_windows(log: DataFrame, step: str, every: int, metrics: list[str]) -> DataFrame:
    """Means over every ``every`` steps: tumbling windows by count."""
    return log.groupBy(F.floor((F.col(step) - 1) / every).cast("bigint").alias("window")).agg(F.min(step).alias("first_step"), F.max(step).alias("last_step"), F.count("*").alias("n"), *[F.avg(m).alias(m) for m in metrics])


def relative_to_max(rows: DataFrame, x: str, name: str) -> DataFrame:
    """x over the largest x of all rows."""
    most = rows.agg(F.max(x).alias("_most"))
    return rows.crossJoin(F.broadcast(most)).withColumn(name, F.try_divide(F.col(x), F.col("_most"))).drop("_most")  # one row


def quantile_bins(rows: DataFrame, x: str, bins: int, tie: str, name: str = "bin") -> DataFrame:
    """1-based bin of about equal sizes by (x, tie), larger bins first, as ntile.

    Ranks come from ``global_rank``, so no task sees all rows.
    """
    ranked = global_rank(rows, [F.asc(x), F.asc(tie)], "_r")
    total = rows.agg(F.count("*").alias("_n"))
    both = ranked.crossJoin(F.broadcast(total))  # one row
    size, more = F.floor(F.col("_n") / bins), F.col("_n") % bins
    wide = more * (size + 1)
    got = F.when(F.col("_r") < wide, F.floor(F.col("_r") / (size + 1)) + 1).otherwise(more + F.floor(F.try_divide(F.col("_r") - wide, size)) + 1)
    return both.withColumn(name, got.cast("int")).drop("_r", "_n")


def global_rank(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """0-based place of each row in a total order.

    Rows are range-partitioned and numbered inside their partition; partition sizes, a
    few numbers, are added up in a small table. The order has to be total.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = settled(placed.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND((1 << 33) - 1)}))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_id", "_part", "_at", "_start")


def evenly_spaced(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """k rows at places trunc(linspace(0, n - 1, k)) of a total order; all rows if there are no more than k."""
    ranked = global_rank(rows, order, "_r")
    n = rows.agg(F.count("*").alias("_n"))
    places = n.select("_n", F.explode(F.when(F.col("_n") > k, F.sequence(F.lit(0), F.lit(k - 1)))).alias("_i"))
    places = places.select(F.floor(F.col("_i") * ((F.col("_n") - 1) / (k - 1.0))).cast("bigint").alias("_r")).distinct()
    if rows.count() <= k:
        return rows
    return ranked.join(F.broadcast(places), "_r", "left_semi").drop("_r")  # at most k places

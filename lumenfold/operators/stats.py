"""Rank correlation, partition agreement, regression and density: one-row or grouped results."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import average_rank, global_quantiles


def correlation(a: str, b: str) -> Column:
    """Pearson correlation, null where a side has no variance (the built-in raises there under ANSI rules)."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with averaged ties; NaN below three rows or without variance."""
    ranked = average_rank(average_rank(rows, a, "_ra"), b, "_rb")
    got = ranked.agg(F.count("*").alias("n"), correlation("_ra", "_rb").alias("_c"))
    return got.select("n", F.when(F.col("n") < 3, F.lit(float("nan"))).otherwise(F.coalesce("_c", F.lit(float("nan")))).alias("rho"))


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def adjusted_rand(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Agreement of two labelings of the same rows; NaN below two rows or for a zero denominator."""
    cells = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    ij = cells.agg(F.sum(_pairs(F.col("n"))).alias("ij"), F.sum("n").alias("n"))
    ai = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("ai"))
    bj = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(_pairs(F.col("n"))).alias("bj"))
    one = ij.crossJoin(ai).crossJoin(bj)  # one row each
    expected = F.try_divide(F.col("ai") * F.col("bj"), _pairs(F.col("n")))
    return one.select("n", F.coalesce(F.try_divide(F.col("ij") - expected, (F.col("ai") + F.col("bj")) / 2 - expected), F.lit(float("nan"))).alias("ari"))


def regression(rows: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Least squares of y on x: n, slope, intercept, r2, pearson and the t statistic of the slope."""
    got = rows.groupBy(*(by or [])).agg(F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), correlation(x, y).alias("pearson"))
    return got.withColumn("t", F.try_divide(F.col("pearson") * F.sqrt(F.greatest(F.col("n") - 2, F.lit(0))), F.sqrt(1 - F.col("r2"))))


def p_value(t: Column, df: Column, steps: int = 2000) -> Column:
    """Two-sided p-value of a t statistic; null without a degree of freedom.

    With x = sqrt(df) tan(a) the density is a power of cos(a), so Simpson sums of the tail and of the half are enough.
    The range stops 40 deviations out, beyond which nothing is left in double precision.
    """
    top = F.least(F.lit(math.pi / 2), 40 / F.sqrt(df))
    at = F.least(F.atan(F.abs(t) / F.sqrt(df)), top)

    def area(low: Column) -> Column:
        h = (top - low) / steps
        weight = lambda k: F.when((k == 0) | (k == steps), 1.0).when(k % 2 == 1, 4.0).otherwise(2.0)
        value = lambda k: F.exp((df - 1) * F.ln(F.greatest(F.cos(low + k * h), F.lit(1e-300))))
        return F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), lambda total, k: total + weight(k) * value(k)) * h / 3

    return F.when(df > 0, F.try_divide(area(at), area(F.lit(0.0))))


def weighted_regression(rows: DataFrame, x: str, y: str, weight: str) -> DataFrame:
    """Slope, intercept and correlation with weights, from weighted sums."""
    w = F.col(weight)
    s = rows.agg(F.sum(w).alias("w"), F.sum(w * F.col(x)).alias("x"), F.sum(w * F.col(y)).alias("y"), F.sum(w * F.col(x) ** 2).alias("xx"), F.sum(w * F.col(y) ** 2).alias("yy"), F.sum(w * F.col(x) * F.col(y)).alias("xy"))
    cov, vx, vy = F.col("xy") - F.col("x") * F.col("y") / F.col("w"), F.col("xx") - F.col("x") ** 2 / F.col("w"), F.col("yy") - F.col("y") ** 2 / F.col("w")
    slope = F.try_divide(cov, vx)
    return s.select(slope.alias("slope"), (F.col("y") / F.col("w") - slope * F.col("x") / F.col("w")).alias("intercept"), F.try_divide(cov, F.sqrt(vx * vy)).alias("pearson"))


def trim_top(rows: DataFrame, x: str, share: float) -> DataFrame:
    """Rows at or below the (1 - share) quantile of x."""
    limit = global_quantiles(rows, x, {"_limit": 1 - share})
    return rows.crossJoin(F.broadcast(limit)).filter(F.col(x) <= F.col("_limit")).drop("_limit")  # one row


def local_density(rows: DataFrame, x: str, counted: str, radius: float, by: list[str] | None = None) -> DataFrame:
    """Adds ``density``: rows with flag ``counted`` within ``radius`` of each row's x (both ends in).

    Rows are dealt to cells of one radius and look at three neighbouring cells' counts of
    distinct values, so no window sorts all rows in one task.
    """
    by = by or []
    cell = lambda c: F.floor(F.col(c) / radius).cast("bigint")
    values = rows.filter(F.col(counted)).groupBy(*by, F.col(x).alias("_y")).agg(F.count("*").alias("_n")).withColumn("_cell", F.explode(F.array(*[F.floor(F.col("_y") / radius).cast("bigint") + k for k in (-1, 0, 1)])))
    asked = rows.select(*by, x).distinct().withColumn("_cell", cell(x))
    near = asked.join(values, [*by, "_cell"], "left").groupBy(*by, x).agg(F.coalesce(F.sum(F.when(F.abs(F.col("_y") - F.col(x)) <= radius, F.col("_n"))), F.lit(0)).alias("density"))
    return rows.join(near, [*by, x])


def ring_ratio(rows: DataFrame, by: list[str], x: str, least: int = 10, edge: float = 0.1) -> DataFrame:
    """For groups of at least ``least``: (max - median) / range, and the share of rows in the top tenth of the range."""
    stats = rows.groupBy(*by).agg(F.count("*").alias("n"), F.median(x).alias("_mid"), F.min(x).alias("_lo"), F.max(x).alias("_hi")).filter(F.col("n") >= least)
    span = F.col("_hi") - F.col("_lo")
    top = rows.join(stats, by).groupBy(*by).agg(F.avg((F.col(x) >= F.col("_hi") - edge * span).cast("double")).alias("top_share"))
    return stats.join(top, by).select(*by, "n", F.try_divide(F.col("_hi") - F.col("_mid"), span).alias("ring"), "top_share")


def running_total(rows: DataFrame, by: list[str], order: list[str], x: str, name: str) -> DataFrame:
    return rows.withColumn(name, F.sum(x).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))

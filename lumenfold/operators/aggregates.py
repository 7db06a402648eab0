"""Aggregates: repeats and clusters, finite means, summaries, histograms, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.scalar import finite, safe_std

from .windows import global_quantiles


def mean_of_repeats(windows: DataFrame, scene: str, metric: str, strict: bool = False) -> DataFrame:
    """scene, value, repeats. Null rows do not count; NaN rows are skipped unless ``strict``, where they make the mean NaN."""
    admitted = windows.filter(F.col(metric).isNotNull()) if strict else windows.filter(finite(F.col(metric)))
    return admitted.groupBy(scene).agg(F.avg(metric).alias("value"), F.count("*").alias("repeats"))


def repeat_range(means: DataFrame) -> DataFrame:
    return means.agg(F.count("*").alias("scenes"), F.min("repeats").alias("least"), F.max("repeats").alias("most"))


def cluster_report(members: DataFrame, values: DataFrame, cluster: str = "cluster", scene: str = "scene") -> DataFrame:
    """Size, scored scenes and their mean, median, deviation, minimum and maximum for each cluster.

    Unweighted mean of scene means; statistics are null for a cluster without a score.
    """
    joined = members.join(values.select(scene, "value"), scene, "left")
    v = F.col("value")
    return joined.groupBy(cluster).agg(
        F.count("*").alias("size"), F.count(v).alias("n"), F.count_if(v.isNull()).alias("missing"), F.avg(v).alias("mean"), F.median(v).alias("median"), safe_std(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
    )


def overall(values: DataFrame, low: float = 0.02, high: float = 0.98, column: str = "value") -> DataFrame:
    """Summary over all scored scenes and the two quantiles that bound a colour scale: one row."""
    plain = values.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.min(column).alias("min"), F.max(column).alias("max"))
    limits = global_quantiles(values, column, {"median": 0.5, "vmin": low, "vmax": high})
    return plain.crossJoin(F.broadcast(limits)).select("n", "mean", "median", "min", "max", "vmin", "vmax")  # one row each


def log_range(pixels: DataFrame, x: str) -> DataFrame:
    """lo and hi of a log quantisation over all rows: one row, as ``clip_range`` has for each group."""
    p = global_quantiles(pixels, x, {"lo": 0.001, "_hi": 0.9999}).withColumn("lo", F.greatest("lo", F.lit(1e-3)))
    return p.select("lo", F.greatest("_hi", F.col("lo") * 1.001).alias("hi"))


def finite_means(rows: DataFrame, metrics: list[str], by: list[str] | None = None) -> DataFrame:
    """metric, mean, n over finite values of each metric; a metric without any is left out."""
    long = rows.unpivot(by or [], metrics, "metric", "x").filter(finite(F.col("x")))
    return long.groupBy(*(by or []), "metric").agg(F.avg("x").alias("mean"), F.count("*").alias("n"))


def means_of_records(records: DataFrame, metrics: str, by: list[str] | None = None) -> DataFrame:
    """metric, mean, n over finite values of a map column; the metrics are the union of the keys of all records."""
    long = records.select(*(by or []), F.explode(metrics).alias("metric", "x")).filter(finite(F.col("x")))
    return long.groupBy(*(by or []), "metric").agg(F.avg("x").alias("mean"), F.count("*").alias("n"))


def window_counts(rows: DataFrame, metric: str) -> DataFrame:
    """Rows, and rows without a finite value of the metric."""
    return rows.agg(F.count("*").alias("windows"), F.count_if(~F.coalesce(finite(F.col(metric)), F.lit(False))).alias("without"))


def split_summary(rows: DataFrame, flag: str, aggregates: list[Column]) -> DataFrame:
    """Summary of all rows, and of both sides of a flag only if both occur."""
    both = rows.groupingSets([[], [flag]], flag).agg(F.grouping(flag).alias("_all"), F.countDistinct(flag).alias("_d"), *aggregates)
    sides = rows.agg(F.countDistinct(flag).alias("_sides"))
    out = both.crossJoin(F.broadcast(sides))  # one row
    name = F.when(F.col("_all") == 1, "all").otherwise(F.col(flag).cast("string"))
    return out.filter((F.col("_all") == 1) | (F.col("_sides") == 2)).select(name.alias("part"), *[c for c in both.columns if c not in (flag, "_all", "_d")])


def biased_means(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """In-training validation: finite sums over ALL batches, as the training loop reports them."""
    return rows.agg(*[(F.sum(F.when(finite(F.col(m)), F.col(m)).otherwise(0.0)) / F.count("*")).alias(m) for m in metrics])


def histogram(rows: DataFrame, status: str) -> DataFrame:
    return rows.groupBy(status).agg(F.count("*").alias("n"))


def split_counts(scenes: DataFrame) -> DataFrame:
    """Scenes of each split and all frames, a missing count being 0."""
    return scenes.agg(F.count_if(F.col("split") == "train").alias("num_train"), F.count_if(F.col("split") == "val").alias("num_val"), F.sum(F.coalesce("num_frames", F.lit(0))).alias("frames"))


def depth_percentiles(obs: DataFrame, by: list[str], z: str) -> DataFrame:
    """5th, 50th and 95th percentile of depth for each frame."""
    p = F.percentile(z, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return obs.groupBy(*by).agg(p[0].alias("p05"), p[1].alias("p50"), p[2].alias("p95"))


def median_of_medians(frames: DataFrame, by: list[str], p50: str = "p50") -> DataFrame:
    return frames.groupBy(*by).agg(F.median(p50).alias("median"))


def scene_scale(points: DataFrame, by: list[str], distance: str, floor: float = 1e-8) -> DataFrame:
    """Mean distance of kept points; 1 and not usable where it is not finite or too small."""
    mean = points.groupBy(*by).agg(F.avg(distance).alias("_m"))
    fine = finite(F.col("_m")) & (F.col("_m") > floor)
    return mean.select(*by, F.when(fine, F.col("_m")).otherwise(1.0).alias("scale"), F.coalesce(fine, F.lit(False)).alias("usable"))


def clip_range(pixels: DataFrame, by: list[str], x: str) -> DataFrame:
    """lo, hi and the clipped share of a log quantisation for each group: percentiles 0.1 and 99.99."""
    p = F.percentile(x, F.array(F.lit(0.001), F.lit(0.9999)))
    lo = F.greatest(p[0], F.lit(1e-3))
    limits = pixels.groupBy(*by).agg(lo.alias("lo"), p[1].alias("_hi")).select(*by, "lo", F.greatest("_hi", F.col("lo") * 1.001).alias("hi"))
    out = pixels.join(limits, by).groupBy(*by, "lo", "hi").agg(F.avg(((F.col(x) < F.col("lo")) | (F.col(x) > F.col("hi"))).cast("double")).alias("clipped"))
    return out


def relative_scale(pixels: DataFrame, by: list[str], x: str, mask: Column, floor: float = 1e-6) -> DataFrame:
    total = F.sum(F.when(mask, F.col(x)).otherwise(0.0)) / F.greatest(F.count_if(mask), F.lit(1))
    return pixels.groupBy(*by).agg(F.greatest(total, F.lit(floor)).alias("scale"))


def contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.groupBy(a, b).agg(F.count("*").alias("n"))


def scene_extent(points: DataFrame, by: list[str], xyz: tuple[str, str, str]) -> DataFrame:
    """Norm of the spans between the 5th and 95th percentile of the axes; 1 where that is not positive."""
    spans = [F.percentile(c, F.array(F.lit(0.05), F.lit(0.95))) for c in xyz]
    got = points.groupBy(*by).agg(*[(s[1] - s[0]).alias(f"_s{k}") for k, s in enumerate(spans)])
    size = F.sqrt(sum((F.col(f"_s{k}") ** 2 for k in (1, 2)), F.col("_s0") ** 2))
    return got.select(*by, F.when(size > 0, size).otherwise(1.0).alias("extent"))


def valid_fraction(pixels: DataFrame, by: list[str], mask: Column) -> DataFrame:
    return pixels.groupBy(*by).agg(F.avg(mask.cast("double")).alias("valid"))

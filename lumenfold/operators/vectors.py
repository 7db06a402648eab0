"""Centroids, similarities and assignments over embedding columns.

Vectors are exploded to (key, dim, value) rows for means, so a mean is one hash
aggregate with map-side combine; arrays come back once a group is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.vector import dot, norm, unit, unit_layers

from .windows import best_and_runner_up


def mean_vectors(rows: DataFrame, by: list[str], vector: str, name: str = "vector", small_groups: bool = False) -> DataFrame:
    """Mean vector of each group.

    With ``small_groups`` (many keys of a few rows each) whole vectors are dealt by key once
    and both aggregates run where they lie; otherwise sums combine before they are dealt.
    """
    if small_groups:
        rows = rows.select(*by, vector).repartition(*by)
    long = rows.select(*by, F.posexplode(vector).alias("_d", "_x"))
    means = long.groupBy(*by, "_d").agg(F.avg("_x").alias("_m"))
    packed = means.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_d", "_m"))).alias("_v"))
    return packed.select(*by, F.transform("_v", lambda s: s["_m"]).alias(name))


def demean_layers(rows: DataFrame, vector: str, n_layers: int, width: int, means: DataFrame | None = None) -> DataFrame:
    """Subtract the mean of all rows (or given means), bring each layer to unit norm, then the whole vector.

    With one layer the vector is only brought to unit norm. ``means``: one row, column ``mean``.
    """
    if n_layers == 1:
        return rows.withColumn(vector, unit(F.col(vector)))
    if means is None:
        means = mean_vectors(rows, [], vector, "mean")
    both = rows.crossJoin(F.broadcast(means.select("mean")))  # one row
    centred = F.zip_with(vector, "mean", lambda x, m: x - m)
    return both.withColumn(vector, centred).withColumn(vector, unit_layers(F.col(vector), n_layers, width)).withColumn(vector, unit(F.col(vector))).drop("mean")


def scene_centroids(images: DataFrame, by: list[str], vector: str, n_layers: int, width: int, means: DataFrame | None = None) -> DataFrame:
    """Mean over the images of a scene after layer de-meaning; not brought to unit norm again.

    A single layer is taken as it is.
    """
    ready = images if n_layers == 1 else demean_layers(images, vector, n_layers, width, means)
    return mean_vectors(ready, by, vector, "centroid", small_groups=True)


def cluster_centroids(scenes: DataFrame, cluster: str, centroid: str = "centroid", score: str = "unit") -> DataFrame:
    """Mean centroid of each cluster, at unit norm for ``score='unit'``."""
    means = mean_vectors(scenes, [cluster], centroid, "centre")
    return means.withColumn("centre", unit(F.col("centre"))) if score == "unit" else means


def cluster_scores(scenes: DataFrame, by: list[str], centres: DataFrame, cluster: str, centroid: str = "centroid", digits: int | None = None) -> DataFrame:
    """Score of every scene against every cluster, joined on the dimension: no cross join of vectors.

    The centres are as many rows as there are clusters times dimensions; the optimizer broadcasts them only if that measures small.
    """
    a = scenes.select(*by, F.posexplode(centroid).alias("_d", "_x"))
    b = centres.select(F.col(cluster).alias("option"), F.posexplode("centre").alias("_d", "_y"))
    total = F.sum(F.col("_x") * F.col("_y"))
    return a.join(b, "_d").groupBy(*by, "option").agg((F.round(total, digits) if digits is not None else total).alias("score"))


#: Numbers in all centres up to which they travel as one row: 8 MB.
MOST_CENTRES = 1 << 20


def nearest_cluster(scenes: DataFrame, by: list[str], centres: DataFrame, cluster: str, centroid: str = "centroid", digits: int = 9) -> DataFrame:
    """Best and second cluster of each scene with the margin; ties go to the smaller cluster.

    Centres are counted first: few travel as a single row, and no scene is shuffled; many are joined on the dimension.
    """
    size = centres.agg(F.sum(F.size("centre"))).first()[0] or 0
    if size > MOST_CENTRES:
        return best_and_runner_up(cluster_scores(scenes, by, centres, cluster, centroid, digits), by, "option", "score")
    packed = centres.agg(F.collect_list(F.struct(F.col(cluster).alias("option"), "centre")).alias("_all"))
    both = scenes.select(*by, centroid).crossJoin(F.broadcast(packed))  # one row of a checked size
    scored = F.array_sort(F.transform("_all", lambda c: F.struct((-F.round(dot(F.col(centroid), c["centre"]), digits)).alias("s"), c["option"].alias("o"))))
    got = both.select(*by, F.slice(scored, 1, 2).alias("_top")).filter(F.size("_top") > 0)
    first, second = (F.get("_top", F.lit(k)) for k in (0, 1))
    out = got.select(*by, first["o"].alias("best"), (-first["s"]).alias("best_score"), second["o"].alias("second"), (-second["s"]).alias("second_score"))
    return out.withColumn("margin", F.col("best_score") - F.col("second_score"))


def cluster_sums(scenes: DataFrame, cluster: str, centroid: str = "centroid") -> DataFrame:
    """For each cluster: members m, sum vector s and sum of squared norms q."""
    v = mean_vectors(scenes, [cluster], centroid, "_mean")
    counts = scenes.groupBy(cluster).agg(F.count("*").alias("m"), F.sum(dot(F.col(centroid), F.col(centroid))).alias("q"))
    return v.join(counts, cluster).select(cluster, "m", "q", F.transform("_mean", lambda x: x * F.col("m")).alias("s"))


def cohesion(scenes: DataFrame, cluster: str, centroid: str = "centroid") -> DataFrame:
    """Mean similarity of the pairs of a cluster by the closed form; null for one member."""
    c = cluster_sums(scenes, cluster, centroid)
    pairs = F.col("m") * (F.col("m") - 1)
    return c.select(cluster, F.col("m").alias("size"), F.try_divide(dot(F.col("s"), F.col("s")) - F.col("q"), pairs).alias("cohesion"))


def typicality(scenes: DataFrame, cluster: str, centroid: str = "centroid") -> DataFrame:
    """Adds ``typicality``: mean similarity to the other members, 0 for a singleton. No pairs arise."""
    c = cluster_sums(scenes, cluster, centroid).select(cluster, "m", "s")
    both = scenes.join(c, cluster)
    own = dot(F.col(centroid), F.col(centroid))
    value = F.coalesce(F.try_divide(dot(F.col(centroid), F.col("s")) - own, F.col("m") - 1), F.lit(0.0))
    return both.withColumn("typicality", value).drop("m", "s")


def modularity(scenes: DataFrame, cluster: str, centroid: str = "centroid", gamma: float = 1.0) -> DataFrame:
    """Modularity of a partition on the complete graph with weights dot + 1, by closed form: one row."""
    c = cluster_sums(scenes, cluster, centroid)
    whole = cluster_sums(scenes.withColumn("_all", F.lit(1)), "_all", centroid).select(F.col("m").alias("n"), F.col("q").alias("all_q"), F.col("s").alias("all_s"))
    both = c.crossJoin(F.broadcast(whole))  # one row
    two_w = dot(F.col("all_s"), F.col("all_s")) - F.col("all_q") + F.col("n") * (F.col("n") - 1)
    inner = dot(F.col("s"), F.col("s")) - F.col("q") + F.col("m") * (F.col("m") - 1)
    strength = dot(F.col("s"), F.col("all_s")) - F.col("q") + F.col("m") * (F.col("n") - 1)
    return both.agg(F.sum(inner / two_w - gamma * (strength / two_w) ** 2).alias("modularity"))


__all__ = ["cluster_centroids", "cluster_scores", "cohesion", "demean_layers", "mean_vectors", "modularity", "nearest_cluster", "norm", "scene_centroids", "typicality"]

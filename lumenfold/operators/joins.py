"""Joins: discovery, fallback matching, covisibility, scoring, upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def discover(images: DataFrame, models: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key with status ok, no_images or no_model; the images are tested first."""
    i, m = images.select(*keys).distinct().withColumn("_i", F.lit(True)), models.select(*keys).distinct().withColumn("_m", F.lit(True))
    status = F.when(F.col("_i").isNull(), "no_images").when(F.col("_m").isNull(), "no_model").otherwise("ok")
    return i.join(m, keys, "full").select(*keys, status.alias("status"))


def match_fallback(left: DataFrame, right: DataFrame, key: str, candidates: list[Column], right_key: Column, value: str) -> DataFrame:
    """Left rows with the right value of the first candidate key that exists, and its place (0, 1...); unmatched rows go."""
    place, out = [], left
    for k, candidate in enumerate(candidates):
        side = right.select(F.col(key).alias(f"_k{k}"), right_key.alias(f"_c{k}"), F.col(value).alias(f"_v{k}"))
        out = out.join(side, (F.col(key) == F.col(f"_k{k}")) & (candidate == F.col(f"_c{k}")), "left").drop(f"_k{k}")
        place.append(F.when(F.col(f"_c{k}").isNotNull(), F.lit(k)))
    got = reduce(lambda v, k: F.when(F.col(f"_c{k}").isNotNull(), F.col(f"_v{k}")).otherwise(v), range(len(candidates) - 1, -1, -1), F.lit(None))
    out = out.withColumns({"match_value": got, "match_place": F.coalesce(*place)}).filter("match_place is not null")
    return out.drop(*[f"{p}{k}" for p in ("_c", "_v") for k in range(len(candidates))])


def keep_observed(keypoints: DataFrame, points: DataFrame, point: str) -> DataFrame:
    """Keypoints of kept points; -1 marks a keypoint without a point."""
    return keypoints.filter(F.col(point) >= 0).join(points.select(point).distinct(), point)


def covisibility(obs: DataFrame, frame: str, point: str, scene: list[str] | None = None, min_shared: int = 1) -> DataFrame:
    """fi < fj, shared, overlap: points seen by both frames over the smaller frame's points.

    A hash join on the point; pairs without a shared point never arise.
    """
    scene = scene or []
    seen = obs.select(*scene, frame, point).distinct()
    sizes = seen.groupBy(*scene, frame).agg(F.count("*").alias("_n"))
    a = seen.withColumnRenamed(frame, "fi")
    b = seen.withColumnRenamed(frame, "fj")
    pairs = a.join(b, [*scene, point]).filter("fi < fj").groupBy(*scene, "fi", "fj").agg(F.count("*").alias("shared")).filter(F.col("shared") >= min_shared)
    pairs = pairs.join(sizes.withColumnsRenamed({frame: "fi", "_n": "_ni"}), [*scene, "fi"]).join(sizes.withColumnsRenamed({frame: "fj", "_n": "_nj"}), [*scene, "fj"])
    return pairs.select(*scene, "fi", "fj", "shared", (F.col("shared") / F.least("_ni", "_nj")).alias("overlap"))


def with_metric(members: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Members with their value, null where there is none."""
    return members.join(values, keys, "left")


def in_list(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(wanted.select(*keys).distinct(), keys, "left_semi")


def not_in_list(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(other.select(*keys).distinct(), keys, "left_anti")


def tag_union(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Both sets with a ``split`` column."""
    return train.withColumn("split", F.lit("train")).unionByName(evaluation.withColumn("split", F.lit("eval")), allowMissingColumns=True)


def upsert(index: DataFrame, attempted: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The index with ``columns`` of attempted keys replaced; other rows and all other columns stay as they are."""
    new = attempted.select(*keys, F.lit(True).alias("_touched"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    both = index.join(new, keys, "left")
    taken = {c: F.when(F.col("_touched"), F.col(f"_new_{c}")).otherwise(F.col(c)) if c in index.columns else F.col(f"_new_{c}") for c in columns}
    return both.withColumns(taken).drop("_touched", *[f"_new_{c}" for c in columns])


def missing_as(rows: DataFrame, values: DataFrame, keys: list[str], column: str, default) -> DataFrame:
    """Left join with a default for missing rows."""
    return rows.join(values, keys, "left").withColumn(column, F.coalesce(column, F.lit(default)))

"""Row filters of dataset assembly and of point clouds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.scalar import finite

from .windows import global_quantiles


def by_split(scenes: DataFrame, split: str = "all", require: bool = False) -> DataFrame:
    """Rows of a split; ``all`` keeps every row. ``require`` raises if none is left."""
    out = scenes if split == "all" else scenes.filter(F.col("split") == split)
    if require and out.isEmpty():
        raise ValueError(f"no scenes in split {split!r}")
    return out


def dense_only(scenes: DataFrame, depth_root: str | None, col: str = "has_depth") -> DataFrame:
    """Scenes with depth; as in the data loader, without a depth root the filter does nothing."""
    return scenes if depth_root is None else scenes.filter(F.coalesce(F.col(col), F.lit(False)))


def min_frames(scenes: DataFrame, least: int) -> DataFrame:
    return scenes.filter(F.coalesce("num_frames", F.lit(0)) >= least)


def modal_shape(rows: DataFrame, shape: list[str], order: str | None = None, explicit: tuple | None = None) -> DataFrame:
    """Rows of the most frequent shape. Ties: the shape that comes first by ``order``, or the smallest shape.

    ``explicit`` asks for one shape and raises if no row has it.
    """
    if explicit is not None:
        out = rows
        for c, v in zip(shape, explicit, strict=True):
            out = out.filter(F.col(c) == v)
        if out.isEmpty():
            raise ValueError(f"no rows of shape {explicit}")
        return out
    tie = [F.col("_first")] if order else [F.col(c) for c in shape]
    counts = rows.groupBy(*shape).agg(F.count("*").alias("_n"), *([F.min(order).alias("_first")] if order else []))
    best = counts.orderBy(F.desc("_n"), *tie).limit(1)  # top-k: one row, merged from one of each task
    return rows.join(best.select(*shape), shape, "left_semi")


def point_quality(points: DataFrame, scene: str, error: str, track: str, max_error: float, min_track: int, min_points: int, fallback_track: int = 2) -> DataFrame:
    """Good points of each scene; if fewer than ``min_points`` are good, points with a track of ``fallback_track``."""
    good = (F.col(error) <= max_error) & (F.col(track) >= min_track)
    counts = points.groupBy(scene).agg(F.count_if(good).alias("_good"))
    both = points.join(counts, scene)
    return both.filter(F.when(F.col("_good") >= min_points, good).otherwise(F.col(track) >= fallback_track)).drop("_good")


def scene_gates(scenes: DataFrame, gates: list[tuple[str, Column]]) -> DataFrame:
    """Adds ``status`` and ``reason``: the first gate that a scene fails, in order."""
    reason = F.coalesce(*[F.when(fails, F.lit(name)) for name, fails in gates])
    return scenes.withColumns({"reason": reason, "status": F.when(reason.isNull(), "ok").otherwise("skip")})


def min_observations(obs: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Observations of frames that have at least ``least``."""
    enough = obs.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    return obs.join(enough.select(*keys), keys, "left_semi")


def outlier_cut(points: DataFrame, scene: str, distance: str, times: float = 100.0) -> DataFrame:
    """Drops points farther than ``times`` the scene's median distance, where that limit is finite and positive."""
    limits = points.filter(finite(F.col(distance)) & (F.col(distance) > 0)).groupBy(scene).agg((F.median(distance) * times).alias("_limit"))
    both = points.join(limits, scene, "left")
    apply = finite(F.col("_limit")) & (F.col("_limit") > 0)
    return both.filter(~apply | F.col("_limit").isNull() | (F.col(distance) <= F.col("_limit"))).drop("_limit")


def background(points: DataFrame, black: bool = False, white: bool = False) -> DataFrame:
    """Drops points of a black or white background by their colour."""
    out = points
    if black:
        out = out.filter(F.col("r") + F.col("g") + F.col("b") >= 16)
    if white:
        out = out.filter(~((F.col("r") > 240) & (F.col("g") > 240) & (F.col("b") > 240)))
    return out


def confidence_percentile(points: DataFrame, conf: str, percent: float, floor: float = 1e-5) -> DataFrame:
    """Points at or above the given percentile of finite confidences, and above the floor."""
    limit = global_quantiles(points.filter(finite(F.col(conf))), conf, {"_limit": percent / 100.0})
    return points.crossJoin(F.broadcast(limit)).filter((F.col(conf) >= F.col("_limit")) & (F.col(conf) > floor)).drop("_limit")  # one row


def files_named(files: DataFrame, path: str, suffixes: tuple[str, ...]) -> DataFrame:
    """Visible files with one of the suffixes."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return files.filter(~name.startswith(".") & F.lower(name).rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))


def first_rows(df: DataFrame, n: int | None, *order: Column) -> DataFrame:
    """The first n rows in an order; all rows for None."""
    return df if n is None else df.orderBy(*order).limit(n)


def require_present(needed: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """``needed`` again, if ``known`` has all its keys; else an error."""
    if not needed.join(known, keys, "left_anti").isEmpty():
        raise ValueError(f"keys {keys} are missing")
    return needed


def every_nth(rows: DataFrame, partition: list[str], order: list[str], n: int) -> DataFrame:
    """Rows 0, n, 2n... of each group in an order."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return rows.withColumn("_at", F.row_number().over(w) - 1).filter(F.col("_at") % n == 0).drop("_at")

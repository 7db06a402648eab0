"""Composed geometry over rows: sparse depth, unprojection, scene normalisation, point selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import rotation as R
from lumenfold.functions.scalar import finite

from .aggregates import scene_scale
from .filters import background, confidence_percentile, outlier_cut
from .windows import depth_edges, evenly_spaced, nearest_surface


def sparse_depth(obs: DataFrame, frame: list[str], u: str, v: str, z: str, width: int, height: int, min_depth: float, *tie: Column) -> DataFrame:
    """Depth of the nearest observed point of each pixel, pixels rounded half-even."""
    px = obs.withColumns({"px": F.rint(u).cast("int"), "py": F.rint(v).cast("int")})
    seen = px.filter(R.in_frustum(F.col("px"), F.col("py"), F.col(z), F.lit(width), F.lit(height), min_depth))
    return nearest_surface(seen, [*frame, "py", "px"], z, *tie)


def normalise_scene(points: DataFrame, scene: list[str], xyz: tuple[str, str, str], times: float = 100.0) -> DataFrame:
    """Points over their scene's mean distance, after far outliers are cut; ``usable`` tells scenes without a fair scale."""
    distance = F.sqrt(sum((F.col(c) ** 2 for c in xyz[1:]), F.col(xyz[0]) ** 2))
    rows = points.withColumn("_d", distance).filter(finite(F.col("_d")) & (F.col("_d") > 0))
    keyed = rows.withColumn("_key", F.struct(*scene))
    cut = outlier_cut(keyed, "_key", "_d", times).drop("_key")
    scale = scene_scale(cut, scene, "_d")
    return cut.join(scale, scene).withColumns({c: F.col(c) / F.col("scale") for c in xyz}).drop("_d")


def select_points(pixels: DataFrame, frame: list[str], row: str, col: str, z: str, conf: str, percent: float, rtol: float | None, black: bool, white: bool, most: int | None, order: list[Column]) -> DataFrame:
    """Points to show: no depth edges, confident, not background, evenly thinned to ``most``."""
    rows = pixels
    if rtol is not None:
        rows = depth_edges(rows, frame, row, col, z, rtol).filter(~F.col("edge")).drop("edge", "low", "high")
    rows = background(confidence_percentile(rows, conf, percent), black, white)
    return evenly_spaced(rows, order, most) if most else rows

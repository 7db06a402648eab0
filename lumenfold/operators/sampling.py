"""Reproducible splits and samples. Draws are hashes of keys and a seed: no order, no partitioning enters."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.scalar import draw_key, hash_unit


def train_val_split(rows: DataFrame, keys: list[str], val_share: float, seed: int = 0, name: str = "split") -> DataFrame:
    """``val`` for about ``val_share`` of the keys, else ``train``."""
    return rows.withColumn(name, F.when(hash_unit(*[F.col(k) for k in keys], F.lit(seed)) < val_share, "val").otherwise("train"))


def images_per_scene(images: DataFrame, scene: list[str], image: str, n: int, seed: int = 0) -> DataFrame:
    """n images of each scene without replacement, as ``slot`` 0..n-1; a scene with fewer repeats its images in turn."""
    w = Window.partitionBy(*scene).orderBy(draw_key(*map(F.col, scene), F.col(image), F.lit(seed)), image)
    ranked = images.withColumns({"_k": F.row_number().over(w) - 1, "_c": F.count("*").over(Window.partitionBy(*scene))}).filter(F.col("_k") < n)
    held = F.least("_c", F.lit(n))
    slots = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda s: s % held == F.col("_k"))
    return ranked.withColumn("slot", F.explode(slots)).drop("_k", "_c")


def contiguous_window(frames: DataFrame, scene: list[str], frame: str, size: int, seed: int = 0) -> DataFrame:
    """``size`` neighbouring frames of each scene from a drawn start; scenes with fewer frames go."""
    w = Window.partitionBy(*scene)
    got = frames.withColumns({"_k": F.row_number().over(w.orderBy(frame)) - 1, "_c": F.count("*").over(w)}).filter(F.col("_c") >= size)
    start = F.floor(hash_unit(*[F.col(s) for s in scene], F.lit(seed)) * (F.col("_c") - size + 1))
    return got.filter((F.col("_k") >= start) & (F.col("_k") < start + size)).drop("_k", "_c")


def random_frames(frames: DataFrame, scene: list[str], frame: str, n: int, seed: int = 0) -> DataFrame:
    """n drawn frames of each scene, without replacement."""
    w = Window.partitionBy(*scene).orderBy(draw_key(*map(F.col, scene), F.col(frame), F.lit(seed)), frame)
    return frames.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")


def shuffled(rows: DataFrame, keys: list[str], seed: int = 0, batch: int | None = None) -> DataFrame:
    """Rows in a drawn order. With ``batch`` the last rows that fill no batch are dropped."""
    out = rows.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys)
    return out if batch is None else out.limit(rows.count() // batch * batch)


def flip_half(frames: DataFrame, scene: list[str], position: str, seed: int = 0) -> DataFrame:
    """Reverses the order of frames for half of the scenes."""
    last = F.max(position).over(Window.partitionBy(*scene))
    flip = hash_unit(*[F.col(s) for s in scene], F.lit(seed)) < 0.5
    return frames.withColumn(position, F.when(flip, last - F.col(position)).otherwise(F.col(position)))


def covisibility_walk(frames: DataFrame, pairs: DataFrame, scene: str, n_frames: int, least: float = 0.1, seed: int = 0) -> DataFrame:
    """scene, frame, pos: frames picked one by one with weights of their best overlap with those picked.

    ``frames``: scene, frame; the walk begins at any of them and the even draw takes any, overlap or not.
    ``pairs``: scene, fi, fj, overlap. A step depends on the one before, so each scene is
    walked in Python; a scene's pair list bounds the group. When nothing overlaps by ``least``, the rest is drawn evenly.
    """

    def walk(of_scene: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        if of_scene.empty:
            return pd.DataFrame({scene: pdf.scene[:0], "frame": pdf.fi[:0], "pos": pdf.fi[:0]})
        name = of_scene.scene.iloc[0]
        overlap: dict[int, dict[int, float]] = {}
        for a, b, w in zip(pdf.fi, pdf.fj, pdf.overlap, strict=True):
            overlap.setdefault(int(a), {})[int(b)] = float(w)
            overlap.setdefault(int(b), {})[int(a)] = float(w)
        known = sorted({int(f) for f in of_scene.frame})
        draw = random.Random(f"{seed}:{name}")
        chosen = [draw.choice(known)]
        while len(chosen) < min(n_frames, len(known)):
            rest = [f for f in known if f not in chosen]
            weights = [max(overlap.get(f, {}).get(c, 0.0) for c in chosen) for f in rest]
            near = [(f, w) for f, w in zip(rest, weights, strict=True) if w >= least]
            if not near:
                chosen += draw.sample(rest, min(n_frames, len(known)) - len(chosen))
                break
            chosen.append(draw.choices([f for f, _ in near], [w for _, w in near])[0])
        return pd.DataFrame({scene: name, "frame": sorted(chosen), "pos": range(len(chosen))})

    kind = dict(frames.dtypes)[scene]
    known = frames.select(scene, "frame").filter("frame IS NOT NULL").distinct().toDF("scene", "frame")
    linked = pairs.select(F.col(scene).alias("scene"), "fi", "fj", "overlap")  # names of its own: both sides may come from one table
    return known.groupBy("scene").cogroup(linked.groupBy("scene")).applyInPandas(walk, f"{scene} {kind}, frame long, pos long")



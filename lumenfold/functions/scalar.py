"""Column expressions over scalars: guards, rounding, sizing, quantisation, colours, schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def positive(x: Column, eps: float = 0.0) -> Column:
    return finite(x) & (x > eps)


def safe_std(x: Column) -> Column:
    """Sample deviation; 0 for one value, null for none."""
    return F.when(F.count(x) == 1, F.lit(0.0)).otherwise(F.stddev_samp(x))


def lower_median(name: str) -> Column:
    """The lower of the two middle values of a column (no averaging)."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{name}`)")


def masked_mean(x: Column, mask: Column) -> Column:
    """Sum of x where mask holds over at least one: an empty mask gives 0."""
    total = F.sum(F.when(mask, x).otherwise(0.0))
    return F.coalesce(total / F.greatest(F.count_if(mask), F.lit(1)), F.lit(0.0))


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def patch_multiple(x: Column, patch: int) -> Column:
    """Nearest positive multiple of ``patch``, halves to even."""
    return F.greatest(F.lit(patch), (F.bround(x / patch) * patch).cast("int"))


def balanced_shape(height: Column, width: Column, resolution: int, patch: int) -> tuple[Column, Column]:
    """Height and width with the area of resolution squared and the aspect kept, in whole patches."""
    aspect = width / height
    return patch_multiple(resolution / F.sqrt(aspect), patch), patch_multiple(resolution * F.sqrt(aspect), patch)


def longest_side_shape(height: Column, width: Column, longest: int, patch: int) -> tuple[Column, Column]:
    """Height and width whose longer side is ``longest``, in whole patches."""
    scale = longest / F.greatest(height, width)
    return patch_multiple(height * scale, patch), patch_multiple(width * scale, patch)


def aspect_crop(height: Column, width: Column, least: float = 0.5, most: float = 2.0) -> Column:
    """Centred box (top, left, height, width) whose width/height lies in [least, most]."""
    w = F.least(width, F.floor(height * most)).cast("int")
    h = F.least(height, F.floor(width / least)).cast("int")
    return F.struct(F.floor((height - h) / 2).cast("int").alias("top"), F.floor((width - w) / 2).cast("int").alias("left"), h.alias("height"), w.alias("width"))


def nearest_index(i: Column, src: Column, out: Column) -> Column:
    """Source index of output index i when resampling by nearest neighbour."""
    return F.least(F.floor(i * src / out).cast("int"), src - 1)


def quantise_log(x: Column, lo: Column, hi: Column) -> Column:
    """Sixteen-bit code of x on a log scale between lo and hi."""
    share = (F.log(F.least(F.greatest(x, lo), hi)) - F.log(lo)) / (F.log(hi) - F.log(lo))
    return F.bround(share * 65535).cast("int")


def dequantise_log(q: Column, lo: Column, hi: Column) -> Column:
    """Value of a code; null at both ends, which mark invalid pixels."""
    value = F.exp(F.log(lo) + q / 65535.0 * (F.log(hi) - F.log(lo)))
    return F.when((q > 0) & (q < 65535), value)


#: The 13 steps of the sequential blue ramp, dark to light.
RAMP = ("#0d366b", "#104281", "#184f95", "#1c5cab", "#256abf", "#2a78d6", "#3987e5", "#5598e7", "#6da7ec", "#86b6ef", "#9ec5f4", "#b7d3f6", "#cde2fb")


def colour(t: Column) -> Column:
    """Hex colour of t, clamped to [0, 1], interpolated between ramp steps, channels half-even."""
    steps = len(RAMP) - 1
    place = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)) * steps
    low = F.least(F.floor(place).cast("int"), F.lit(steps - 1))
    share = place - low
    parts = []
    for k in range(3):
        channel = F.array(*[F.lit(float(int(c[1 + 2 * k : 3 + 2 * k], 16))) for c in RAMP])
        parts.append(F.bround(F.get(channel, low) * (1 - share) + F.get(channel, low + 1) * share).cast("int"))
    return F.when(t.isNotNull(), F.format_string("#%02x%02x%02x", *parts))


def on_scale(v: Column, low: Column, high: Column) -> Column:
    """(v - low) / (high - low), with a span of 0 read as 1."""
    span = high - low
    return (v - low) / F.when(span == 0, 1.0).otherwise(span)


def learning_rate(step: Column, warmup: int, total: int, floor: float) -> Column:
    """Linear warm-up, then cosine down to ``floor``."""
    share = F.least(F.greatest((step - warmup) / float(max(total - warmup, 1)), F.lit(0.0)), F.lit(1.0))
    return F.when(step < warmup, (step + 1) / float(max(warmup, 1))).otherwise(floor + (1 - floor) * 0.5 * (1 + F.cos(F.lit(math.pi) * share)))


def draw_key(*keys: Column) -> Column:
    """Hex digits that a draw goes by: a digest of the keys as text, the same on every engine and partitioning."""
    return F.md5(F.concat_ws("|", *[k.cast("string") for k in keys]))


def hash_unit(*keys: Column) -> Column:
    """A number in [0, 1) from the first twelve digits of ``draw_key``."""
    return F.conv(F.substring(draw_key(*keys), 1, 12), 16, 10).cast("double") / float(1 << 48)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"(?<=.)(\.[^.]*)$", 1))


def frame_step(fps: Column, sample_fps: float) -> Column:
    """Every how many frames one is taken: half-even, at least 1."""
    return F.greatest(F.bround(fps / sample_fps).cast("int"), F.lit(1))

"""Pose and depth metrics as aggregates over pose rows and pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import rotation as R
from lumenfold.functions.scalar import finite, lower_median

from .aggregates import finite_means
from .windows import forward_pairs, lower_quantile

DEPTH = ("abs_rel", "delta", "scale_ratio")
POSE = ("tx", "ty", "tz", "qx", "qy", "qz", "qw", "fov_h", "fov_w")


def pose_pair_errors(poses: DataFrame, window: str, frame: str, pred: str = "p_", gt: str = "g_") -> DataFrame:
    """window, i, j, rot, trans: relative rotation and translation-direction errors in degrees of all frame pairs of a window.

    An equi join on the window with i < j; windows are short, so pairs stay few.
    """
    cols = [f"{p}{c}" for p in (pred, gt) for c in POSE[:7]]
    a = poses.select(F.col(window), F.col(frame).alias("i"), *[F.col(c).alias(f"a_{c}") for c in cols])
    b = poses.select(F.col(window), F.col(frame).alias("j"), *[F.col(c).alias(f"b_{c}") for c in cols])
    pairs = a.join(b, window).filter("i < j")

    def relative(p: str) -> tuple[R.Matrix, list[Column]]:
        ra, rb = (R.quat_to_matrix(*[F.col(f"{s}_{p}{c}") for c in POSE[3:7]]) for s in "ab")
        ta, tb = ([F.col(f"{s}_{p}{c}") for c in POSE[:3]] for s in "ab")
        rel = R.multiply(rb, R.transpose(ra))
        return rel, [x - y for x, y in zip(tb, R.apply(rel, ta), strict=True)]

    (rp, tp), (rg, tg) = relative(pred), relative(gt)
    return pairs.select(window, "i", "j", R.rotation_degrees(rp, rg).alias("rot"), R.direction_degrees(tp, tg).alias("trans"))


def _credit(max_deg: int) -> Column:
    worst = F.greatest("rot", "trans")
    return F.when(F.isnan("rot") | F.isnan("trans") | worst.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), max_deg - F.floor(worst).cast("double"))) / max_deg


def pose_auc(errors: DataFrame, by: list[str], max_deg: int = 30) -> DataFrame:
    """Mean over 1..max_deg of the share of pairs whose worse error is below the limit, in closed form; NaN earns nothing."""
    return errors.groupBy(*by).agg(F.avg(_credit(max_deg)).alias(f"auc_at_{max_deg}"))


def _shares(degrees: int) -> list[Column]:
    return [F.avg((F.col(c) < degrees).cast("double")).alias(f"{name}_at_{degrees}") for c, name in (("rot", "rra"), ("trans", "rta"))]


def pooled_pairs(errors: DataFrame, by: list[str], degrees: tuple[int, ...] = (5, 15)) -> DataFrame:
    """Pairs, and shares below each limit, of pooled pairs."""
    return errors.groupBy(*by).agg(F.count("*").alias("pairs"), *[c for d in degrees for c in _shares(d)])


def pose_summary(errors: DataFrame, by: list[str]) -> DataFrame:
    """Means, lower medians, shares below 5 degrees and AUC@30 of pooled pairs."""
    return errors.groupBy(*by).agg(
        F.count("*").alias("pairs"), F.avg("rot").alias("rot_mean"), lower_median("rot").alias("rot_median"), F.avg("trans").alias("trans_mean"), lower_median("trans").alias("trans_median"),
        *_shares(5), F.avg(_credit(30)).alias("auc_at_30"),
    )


def field_of_view_error(poses: DataFrame, by: list[str], pred: str = "p_", gt: str = "g_") -> DataFrame:
    """Mean absolute error of both fields of view in degrees."""
    off = sum(F.abs(F.col(f"{pred}{c}") - F.col(f"{gt}{c}")) for c in POSE[7:]) / 2
    return poses.groupBy(*by).agg(F.avg(F.degrees(off)).alias("fov_err_deg"))


def depth_metrics(pixels: DataFrame, by: list[str], pred: str, gt: str, mask: Column | None = None, align_median: bool = False, eps: float = 1e-6) -> DataFrame:
    """abs_rel, delta and scale_ratio of valid pixels for each group; groups without a valid pixel have NaN.

    scale_ratio: lower median of gt over that of pred; ``align_median`` scales predictions by it first.
    """
    valid = finite(F.col(gt)) & (F.col(gt) > eps)
    if mask is not None:
        valid = valid & mask
    good = pixels.filter(valid).select(*by, F.greatest(F.col(pred), F.lit(eps)).alias("_p"), F.greatest(F.col(gt), F.lit(eps)).alias("_g"))
    scales = good.groupBy(*by).agg((lower_median("_g") / lower_median("_p")).alias("scale_ratio"))
    both = good.join(scales, by).withColumn("_q", F.col("_p") * F.col("scale_ratio") if align_median else F.col("_p"))
    got = both.groupBy(*by, "scale_ratio").agg(F.avg(F.abs(F.col("_q") - F.col("_g")) / F.col("_g")).alias("abs_rel"), F.avg((F.greatest(F.col("_q") / F.col("_g"), F.col("_g") / F.col("_q")) < 1.25).cast("double")).alias("delta"))
    nan = F.lit(float("nan"))
    return pixels.select(*by).distinct().join(got, by, "left").select(*by, *[F.coalesce(c, nan).alias(c) for c in ("abs_rel", "delta", "scale_ratio")])


def window_metrics(poses: DataFrame, pixels: DataFrame, window: str, frame: str, pred: str, gt: str) -> DataFrame:
    """One row a window: pose and field-of-view errors beside depth metrics, NaN where a window has no valid depth."""
    pose = pose_summary(pose_pair_errors(poses, window, frame), [window]).join(field_of_view_error(poses, [window]), window)
    depth = depth_metrics(pixels, [window], pred, gt)
    return pose.join(depth, window, "left").withColumns({c: F.coalesce(c, F.lit(float("nan"))) for c in DEPTH})


def summarise(records: DataFrame, errors: DataFrame, by: list[str]) -> DataFrame:
    """metric, value: finite means of the records and how many went in, pooled pair statistics, window counts."""
    metrics = [c for c in records.columns if c not in by]
    means = finite_means(records.select(*[F.col(c).cast("double").alias(c) for c in metrics]), metrics)
    pooled = errors.agg(
        F.avg(_credit(30)).alias("auc_at_30"), *[c for d in (5, 15) for c in _shares(d)], F.avg("rot").alias("rot_err_deg_mean"), F.avg("trans").alias("trans_err_deg_mean"), F.count("*").alias("num_pairs"),
    ).filter("num_pairs > 0")
    windows = records.agg(F.count("*").alias("num_windows"), F.count_if(~F.coalesce(finite(F.col("abs_rel")), F.lit(False))).alias("num_windows_no_depth"))
    middles = [lower_quantile(errors, c, f"{c}_err_deg_median") for c in ("rot", "trans")]
    out = means.select(F.concat(F.lit("window_"), "metric").alias("metric"), F.col("mean").alias("value"))
    out = out.unionByName(means.select(F.concat(F.lit("window_"), "metric", F.lit("_n")).alias("metric"), F.col("n").cast("double").alias("value")))
    for one in (pooled, windows, *middles):
        out = out.unionByName(one.select(*[F.col(c).cast("double").alias(c) for c in one.columns]).unpivot([], one.columns, "metric", "value"))
    return out


def camera_loss(poses: DataFrame, by: list[str], pred: str = "p_", gt: str = "g_", weights: tuple[float, float, float] = (1.0, 1.0, 0.5)) -> DataFrame:
    """Absolute errors of translation, sign-aligned quaternion and field of view, and their weighted sum."""
    p, g = ({c: F.col(f"{s}{c}") for c in POSE} for s in (pred, gt))
    turn = F.when(sum((p[c] * g[c] for c in POSE[4:7]), p["qx"] * g["qx"]) < 0, -1.0).otherwise(1.0)
    mean = lambda cols, sign=None: sum((F.abs((p[c] * sign if sign is not None else p[c]) - g[c]) for c in cols[1:]), F.abs((p[cols[0]] * sign if sign is not None else p[cols[0]]) - g[cols[0]])) / len(cols)
    got = poses.groupBy(*by).agg(F.avg(mean(POSE[:3])).alias("cam_trans"), F.avg(mean(POSE[3:7], turn)).alias("cam_rot"), F.avg(mean(POSE[7:])).alias("cam_fov"))
    total = weights[0] * F.col("cam_trans") + weights[1] * F.col("cam_rot") + weights[2] * F.col("cam_fov")
    return got.withColumn("loss_camera", total)


def uncertainty_loss(pixels: DataFrame, by: list[str], pred: str, gt: str, conf: str, mask: Column, alpha: float = 0.2) -> DataFrame:
    """Masked means of confidence-weighted residuals minus alpha times log confidence, and of the plain residuals."""
    err = F.abs(F.col(pred) - F.col(gt))
    term = F.when(mask, F.col(conf) * err - alpha * F.log(conf)).otherwise(0.0)
    n = F.greatest(F.count_if(mask), F.lit(1))
    return pixels.groupBy(*by).agg((F.sum(term) / n).alias("conf_loss"), (F.sum(F.when(mask, err).otherwise(0.0)) / n).alias("err"), F.avg(mask.cast("double")).alias("valid"))


def gradient_loss(pixels: DataFrame, by: list[str], y: str, x: str, pred: str, gt: str, conf: str, mask: Column) -> DataFrame:
    """Means of confidence times the step of the residual between valid neighbours, along both axes and added; 0 without such a pair."""
    got = pixels.select(*by).distinct()
    cells = pixels.select(*by, F.col(y).alias("_row"), F.col(x).alias("_col"), (F.col(pred) - F.col(gt)).alias("_e"), F.col(conf).alias("_c"), mask.alias("_ok"))
    for across, along, name in (("_row", "_col", "grad_w"), ("_col", "_row", "grad_h")):
        back = cells.withColumn("_back", -F.col(along))  # from the later cell, whose confidence counts
        pairs = forward_pairs(back, [*by, across], "_back", "_e", "_ok")
        got = got.join(pairs.groupBy(*by).agg(F.avg(F.col("_c") * F.abs("diff")).alias(name)), by, "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    return got.withColumn("loss_grad", F.col("grad_w") + F.col("grad_h"))


def total_loss(rows: DataFrame, weights: dict[str, float], name: str = "loss") -> DataFrame:
    """Weighted sum of the terms that are present and have a weight."""
    terms = [w * F.coalesce(F.col(c), F.lit(0.0)) for c, w in weights.items() if w and c in rows.columns]
    return rows.withColumn(name, sum(terms[1:], terms[0]) if terms else F.lit(0.0))

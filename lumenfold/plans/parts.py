"""Queries of single operators and functions beside their DuckDB statements. Each calls the operator itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import rotation as R
from lumenfold.functions import scalar as S
from lumenfold.functions import vector as VE
from lumenfold.operators import aggregates as A
from lumenfold.operators import filters as P
from lumenfold.operators import geometry as G
from lumenfold.operators import joins as J
from lumenfold.operators import metrics as M
from lumenfold.operators import stats as ST
from lumenfold.operators import windows as W

from . import catalog as C
from . import tables as T

query, _r = C.query, C._r

# --------------------------------------------------------------------- reports


@query(f"WITH {C._REPORT} SELECT cluster, n, round(mean, 6) AS mean, row_number() OVER (ORDER BY round(mean, 9) ASC NULLS LAST, cluster) AS place_up, row_number() OVER (ORDER BY round(mean, 9) DESC NULLS LAST, cluster) AS place_down FROM report")
def report_resorted(spark: SparkSession, d: str) -> DataFrame:
    """A report resorted both ways; clusters without a score stay last."""
    values = A.mean_of_repeats(T.eval_window(spark, d), "scene", "value")
    got = A.cluster_report(T.members(spark, d), values).withColumn("_m", F.round("mean", 9))
    up = W.placed_by(got, F.asc_nulls_last("_m"), F.asc("cluster"), name="place_up")
    down = W.placed_by(up, F.desc_nulls_last("_m"), F.asc("cluster"), name="place_down")
    return down.select("cluster", "n", _r("mean"), "place_up", "place_down")


@query(f"""WITH {C._FEATURE}, a AS (SELECT scene, cluster AS x FROM feature WHERE img_no = 0), b AS (SELECT scene, cluster AS y FROM feature WHERE img_no = 1), c AS (SELECT x, y, count(*) AS n FROM a JOIN b USING (scene) GROUP BY ALL),
p AS (SELECT sum(n * (n - 1) / 2) AS ij, sum(n) AS n FROM c), q AS (SELECT sum(n * (n - 1) / 2) AS ai FROM (SELECT sum(n) AS n FROM c GROUP BY x)), r AS (SELECT sum(n * (n - 1) / 2) AS bj FROM (SELECT sum(n) AS n FROM c GROUP BY y))
SELECT n::BIGINT AS n, round((ij - ai * bj / (n * (n - 1) / 2)) / ((ai + bj) / 2 - ai * bj / (n * (n - 1) / 2)), 6) AS ari FROM p, q, r""")
def two_labelings_rand(spark: SparkSession, d: str) -> DataFrame:
    """Two labelings joined on the scenes that both have, then their agreement."""
    of = lambda k, name: T.feature(spark, d).filter(F.col("img_no") == k).select("scene", F.col("cluster").alias(name))
    return ST.adjusted_rand(of(0, "x").join(of(1, "y"), "scene"), "x", "y").select("n", _r("ari"))


@query(f"WITH {C._TYPICALITY}, o AS (SELECT cluster, scene, row_number() OVER (PARTITION BY cluster ORDER BY round(typicality, 9) DESC, scene) AS k, count(*) OVER (PARTITION BY cluster) AS size FROM t) SELECT cluster, scene, k || '/' || size AS label FROM o")
def most_typical_labels(spark: SparkSession, d: str) -> DataFrame:
    """Most typical first: each scene's rank in its cluster as k/size."""
    rows = C.V.typicality(C._ready(spark, d), "cluster").withColumn("_t", F.round("typicality", 9))
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("size"))
    got = W.ordinal(rows, ["cluster"], F.desc("_t"), F.asc("scene")).join(sizes, "cluster")
    return got.select("cluster", "scene", F.concat_ws("/", (F.col("ordinal") + 1).cast("string"), F.col("size").cast("string")).alias("label"))


# --------------------------------------------------------- filters and guards


@query(f"WITH {C._OBS} SELECT frame, line, point FROM (SELECT *, floor(error * 5) AS r, floor(discount * 2500) AS g, floor(tax * 3000) AS b FROM obs) WHERE r + g + b >= 16 AND NOT (r > 240 AND g > 240 AND b > 240)")
def background_colours(spark: SparkSession, d: str) -> DataFrame:
    rows = T.observations(spark, d).withColumns({"r": F.floor(F.col("error") * 5), "g": F.floor(F.col("discount") * 2500), "b": F.floor(F.col("tax") * 3000)})
    return P.background(rows, black=True, white=True).select("frame", "line", "point")


_PATHS = "paths AS (SELECT doc_id, '/data/' || lang || '/' || CASE WHEN doc_id % 7 = 0 THEN '.' ELSE '' END || source || '_' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' ELSE '.txt' END AS path FROM documents)"


def _paths(spark: SparkSession, d: str) -> DataFrame:
    ending = F.when(F.col("doc_id") % 3 == 0, ".JPG").when(F.col("doc_id") % 3 == 1, ".png").otherwise(".txt")
    hidden = F.when(F.col("doc_id") % 7 == 0, ".").otherwise("")
    return T.read(spark, d, "documents").select("doc_id", F.concat(F.lit("/data/"), "lang", F.lit("/"), hidden, "source", F.lit("_"), F.col("doc_id").cast("string"), ending).alias("path"))


@query(f"WITH {_PATHS} SELECT doc_id, path FROM paths WHERE regexp_matches(path, '(?i)/[^./][^/]*\\.(jpg|png)$')")
def image_files(spark: SparkSession, d: str) -> DataFrame:
    return P.files_named(_paths(spark, d), "path", (".jpg", ".png"))


@query(f"WITH {_PATHS}, n AS (SELECT doc_id, regexp_extract(path, '([^/]*)$', 1) AS name FROM paths) SELECT doc_id, name, regexp_replace(name, '^(.+)\\.[^.]*$', '\\1') AS stem, lower(regexp_extract(name, '.(\\.[^.]*)$', 1)) AS suffix FROM n")
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return _paths(spark, d).select("doc_id", S.basename(p).alias("name"), S.stem(p).alias("stem"), S.suffix(p).alias("suffix"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def first_hundred(spark: SparkSession, d: str) -> DataFrame:
    """Head N of an order: the limit is the operator."""
    return P.first_rows(T.read(spark, d, "orders"), 100, F.desc("o_totalprice"), F.asc("o_orderkey")).select("o_orderkey", "o_totalprice")


@query("SELECT DISTINCT l_suppkey AS s_suppkey FROM lineitem")
def present_keys(spark: SparkSession, d: str) -> DataFrame:
    """Every supplier of an order line is known: else this raises."""
    return P.require_present(T.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("s_suppkey")).distinct(), T.read(spark, d, "supplier"), ["s_suppkey"])


@query(f"WITH {C._SCENES} SELECT scene, num_frames FROM scenes WHERE subset = 'de'")
def split_filter(spark: SparkSession, d: str) -> DataFrame:
    return P.by_split(T.scenes(spark, d).withColumn("split", F.col("subset")), "de", require=True).select("scene", "num_frames")


@query("SELECT d.doc_id, coalesce(l.quality, 0)::INTEGER AS frames FROM documents d LEFT JOIN labels l USING (doc_id)")
def missing_depth_is_zero(spark: SparkSession, d: str) -> DataFrame:
    frames = T.read(spark, d, "labels").select("doc_id", F.col("quality").cast("int").alias("frames"))
    return J.missing_as(T.read(spark, d, "documents").select("doc_id"), frames, ["doc_id"], "frames", 0)


# ------------------------------------------------------------------ aggregates


@query(f"WITH {C._OBS} SELECT supp, round(coalesce(sum(CASE WHEN line <= 4 THEN z END) / greatest(count(*) FILTER (WHERE line <= 4), 1), 0), 4) AS masked, round(greatest(coalesce(sum(CASE WHEN discount > 0.05 THEN z ELSE 0 END), 0) / greatest(count(*) FILTER (WHERE discount > 0.05), 1), 1e-6), 4) AS scale, round(avg((tax < 0.04)::INTEGER), 6) AS valid FROM obs GROUP BY supp")
def masked_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """Masked mean, relative scale and valid share of each group."""
    obs = T.observations(spark, d)
    masked = obs.groupBy("supp").agg(F.round(S.masked_mean(F.col("z"), F.col("line") <= 4), 4).alias("masked"))
    scale = A.relative_scale(obs, ["supp"], "z", F.col("discount") > 0.05).select("supp", _r("scale", 4))
    return masked.join(scale, "supp").join(A.valid_fraction(obs, ["supp"], F.col("tax") < 0.04).select("supp", _r("valid")), "supp")


@query(f"WITH {C._PAIR_ERRORS} SELECT win AS \"window\", round(avg(list_sum(list_transform(range(1, 11), lambda k: (greatest(rot, trans) < k)::INTEGER))) / 10, 6) AS auc_at_10 FROM err GROUP BY win")
def pose_auc(spark: SparkSession, d: str) -> DataFrame:
    return M.pose_auc(C._errors(spark, d), ["window"], 10).select("window", _r("auc_at_10"))


@query(f"WITH {C._PAIR_ERRORS} SELECT count(*) AS pairs, round(avg((rot < 5)::INTEGER), 6) AS rra_at_5, round(avg((trans < 5)::INTEGER), 6) AS rta_at_5, round(avg((rot < 15)::INTEGER), 6) AS rra_at_15, round(avg((trans < 15)::INTEGER), 6) AS rta_at_15 FROM err")
def pooled_pose_pairs(spark: SparkSession, d: str) -> DataFrame:
    return M.pooled_pairs(C._errors(spark, d), []).select("pairs", _r("rra_at_5"), _r("rta_at_5"), _r("rra_at_15"), _r("rta_at_15"))


_CAMERA = f"""{C._POSES}, c AS (SELECT win, v, list_transform(range(1, 8), lambda k: 0.25 * v[k+7]) AS off, list_transform(range(4, 8), lambda k: v[k] + 0.25 * v[k+7]) AS gq FROM poses),
s AS (SELECT win, v, off, gq, CASE WHEN list_dot_product(v[4:7], gq) < 0 THEN -1 ELSE 1 END AS turn FROM c),
l AS (SELECT win, avg((abs(off[1]) + abs(off[2]) + abs(off[3])) / 3) AS t, avg((abs(turn * v[4] - gq[1]) + abs(turn * v[5] - gq[2]) + abs(turn * v[6] - gq[3]) + abs(turn * v[7] - gq[4])) / 4) AS q,
 avg((abs(0.5 * (v[15] - v[17])) + abs(0.5 * (v[16] - v[18]))) / 2) AS f FROM s GROUP BY win)"""


@query(f'WITH {_CAMERA} SELECT win AS "window", round(t, 6) AS cam_trans, round(q, 6) AS cam_rot, round(f, 6) AS cam_fov, round(t + q + 0.5 * f, 6) AS loss_camera, round(degrees(f), 5) AS fov_err_deg FROM l')
def camera_loss(spark: SparkSession, d: str) -> DataFrame:
    rows = T.poses(spark, d)
    got = M.camera_loss(rows, ["window"]).join(M.field_of_view_error(rows, ["window"]), "window")
    return got.select("window", *[_r(c) for c in ("cam_trans", "cam_rot", "cam_fov", "loss_camera")], _r("fov_err_deg", 5))


@query(f"""WITH {C._OBS}, p AS (SELECT supp, abs(z * (1 - discount) - z) AS err, 1 + tax AS conf, line <= 4 AS ok FROM obs), l AS (SELECT supp, sum(CASE WHEN ok THEN conf * err - 0.2 * ln(conf) ELSE 0 END) / greatest(count(*) FILTER (WHERE ok), 1) AS conf_loss, sum(CASE WHEN ok THEN err ELSE 0 END) / greatest(count(*) FILTER (WHERE ok), 1) AS err, avg(ok::INTEGER) AS valid FROM p GROUP BY supp)
SELECT supp, round(conf_loss, 4) AS conf_loss, round(err, 4) AS err, round(valid, 6) AS valid, round(conf_loss + 0.5 * err, 4) AS loss FROM l""")
def uncertainty_loss(spark: SparkSession, d: str) -> DataFrame:
    """Confidence-weighted residuals, and their weighted sum with the plain ones."""
    px = T.observations(spark, d).withColumns({"pred": F.col("z") * (1 - F.col("discount")), "conf": 1 + F.col("tax")})
    got = M.total_loss(M.uncertainty_loss(px, ["supp"], "pred", "z", "conf", F.col("line") <= 4), {"conf_loss": 1.0, "err": 0.5, "absent": 2.0})
    return got.select("supp", _r("conf_loss", 4), _r("err", 4), _r("valid"), _r("loss", 4))


# -------------------------------------------------------------------- geometry


@query(f"WITH {C._OBS}, p AS (SELECT *, round_even(error + discount * 7, 0)::INTEGER AS px, round_even(tax * 300 + line, 0)::INTEGER AS py FROM obs) SELECT supp, py, px, z, frame, line FROM p WHERE px BETWEEN 0 AND 39 AND py BETWEEN 0 AND 19 AND z > 1000 QUALIFY row_number() OVER (PARTITION BY supp, py, px ORDER BY z, frame, line, point) = 1")
def sparse_depth(spark: SparkSession, d: str) -> DataFrame:
    obs = T.observations(spark, d).withColumns({"u": F.col("error") + F.col("discount") * 7, "v": F.col("tax") * 300 + F.col("line")})
    return G.sparse_depth(obs, ["supp"], "u", "v", "z", 40, 20, 1000.0, F.asc("frame"), F.asc("line"), F.asc("point")).select("supp", "py", "px", "z", "frame", "line")


def _pose(spark: SparkSession, d: str, of: str = "p") -> tuple[DataFrame, list, list]:
    """Pose rows with their rotation as nine columns, and the columns of rotation and translation."""
    rows = T.poses(spark, d)
    m = R.quat_to_matrix(*[F.col(f"{of}_{c}") for c in ("qx", "qy", "qz", "qw")])
    rows = rows.withColumns({f"m{k}": c for k, c in enumerate(m)})
    return rows, [F.col(f"m{k}") for k in range(9)], [F.col(f"{of}_{c}") for c in ("tx", "ty", "tz")]


_BACK = ["(" + " + ".join(f"pr[{3 * k + i + 1}]*pt[{k + 1}]" for k in range(3)) + ")" for i in range(3)]


@query(f"WITH {C._POSE_MATS} SELECT vec_id, {', '.join(f'round(-{e}, 6) + 0.0 AS {c}' for e, c in zip(_BACK, 'xyz', strict=True))}, true AS same FROM mats")
def pose_inverse(spark: SparkSession, d: str) -> DataFrame:
    """The inverse of each pose; the inverse of that is the pose again."""
    rows, m, t = _pose(spark, d)
    back, moved = R.se3_inverse(m, t)
    again, home = R.se3_inverse(back, moved)
    same = F.lit(True)
    for a, b in zip([*again, *home], [*m, *t], strict=True):
        same = same & (F.abs(a - b) < 1e-9)
    return rows.select("vec_id", *[(F.round(c, 6) + 0.0).alias(n) for c, n in zip(moved, "xyz", strict=True)], same.alias("same"))


_SEEN = [f"({e} + pt[{k + 1}])" for k, e in enumerate(C._app("pr", "[0.3, -0.2, 5.0]"))]


@query(f"WITH {C._POSE_MATS}, s AS (SELECT vec_id, {', '.join(f'{e} AS {c}' for e, c in zip(_SEEN, 'xyz', strict=True))} FROM mats) SELECT vec_id, round(z, 6) AS z, abs(z) > 1e-3 AS seen, CASE WHEN abs(z) > 1e-3 THEN round(x * 500 / z + 320, 3) END AS u, CASE WHEN abs(z) > 1e-3 THEN round(y * 400 / z + 240, 3) END AS v, CASE WHEN abs(z) > 1e-3 THEN true END AS back FROM s")
def project_and_back(spark: SparkSession, d: str) -> DataFrame:
    """A world point in the pixels of each pose, and back from its pixel and depth."""
    rows, m, t = _pose(spark, d)
    p = [F.lit(0.3), F.lit(-0.2), F.lit(5.0)]
    cam = (F.lit(500.0), F.lit(400.0), F.lit(320.0), F.lit(240.0))
    u, v, z = R.project(m, t, *cam, p)
    rows = rows.withColumns({"u": u, "v": v, "z": z})
    home = R.unproject(F.col("u"), F.col("v"), F.col("z"), m, t, *cam)
    back = F.lit(True)
    for a, b in zip(home, p, strict=True):
        back = back & (F.abs(a - b) < 1e-6)
    seen = F.abs("z") > 1e-3
    return rows.select("vec_id", _r("z"), seen.alias("seen"), F.when(seen, F.round("u", 3)).alias("u"), F.when(seen, F.round("v", 3)).alias("v"), F.when(seen, back).alias("back"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 1 THEN a WHEN 0 THEN a WHEN 2 THEN a WHEN 3 THEN a ELSE a END AS fx, CASE WHEN p_partkey % 6 IN (0, 2, 3) THEN a ELSE b END AS fy, CASE WHEN p_partkey % 6 IN (0, 2, 3) THEN b ELSE 3.0::DOUBLE END AS cx, (CASE WHEN p_partkey % 6 IN (0, 2, 3) THEN 3.0 ELSE 4.0 END)::DOUBLE AS cy,
(CASE p_partkey % 6 WHEN 0 THEN 0.0 WHEN 1 THEN 0.0 WHEN 2 THEN 4.0 WHEN 3 THEN 9.0 WHEN 4 THEN 26.0 ELSE 35.0 END)::DOUBLE AS dist FROM (SELECT p_partkey, p_size + 100.0::DOUBLE AS a, p_size + 200.0::DOUBLE AS b FROM part)""")
def camera_models(spark: SparkSession, d: str) -> DataFrame:
    """Pinhole form of six camera models; dist: the sum of the distortion terms."""
    size = F.col("p_size").cast("double")
    params = F.array(size + 100, size + 200, *[F.lit(float(k)) for k in (3, 4, 5, 6, 7, 8, 9)])
    names = F.array(*[F.lit(n) for n in ("SIMPLE_PINHOLE", "PINHOLE", "SIMPLE_RADIAL", "RADIAL", "OPENCV", "FULL_OPENCV")])
    rows = T.read(spark, d, "part").select("p_partkey", R.to_pinhole(F.get(names, (F.col("p_partkey") % 6).cast("int")), params).alias("c"))
    return rows.select("p_partkey", "c.fx", "c.fy", "c.cx", "c.cy", F.aggregate("c.dist", F.lit(0.0), lambda s, x: s + x).alias("dist"))


@query("SELECT p_partkey, p_size * 518.0 / 640 AS fx, p_size * 2.0 * 392 / 480 AS fy, 259.0::DOUBLE AS cx, 196.0::DOUBLE AS cy, (p_size - 0.5)::DOUBLE AS half_x, least(floor((p_partkey % 10) * p_size / 10)::INTEGER, p_size - 1)::INTEGER AS source FROM part")
def resized_cameras(spark: SparkSession, d: str) -> DataFrame:
    """Intrinsics of a resized image, half-pixel shift and nearest-neighbour indices."""
    f = F.col("p_size").cast("double")
    new = R.rescale_intrinsics(f, f * 2, F.lit(480.0), F.lit(640.0), F.lit(392.0), F.lit(518.0))
    half, _ = R.half_pixel_intrinsics(f, f)
    index = S.nearest_index(F.col("p_partkey") % 10, F.col("p_size").cast("int"), F.lit(10))
    return T.read(spark, d, "part").select("p_partkey", *[c.alias(n) for n, c in new.items()], half.alias("half_x"), index.cast("int").alias("source"))


# --------------------------------------------------------------------- vectors


@query("WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS cosine, round(list_cosine_similarity(a.v, b.v) * sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)), 6) AS dot FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def neighbour_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = T.read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")
    return both.select("vec_id", F.round(VE.cosine(F.col("v"), F.col("w")), 6).alias("cosine"), F.round(VE.dot(F.col("v"), F.col("w")), 6).alias("dot"))


@query("WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n, list_avg(v) AS m FROM e) SELECT vec_id, round(v[1] / n, 6) AS unit, round(2 * (v[1] - m) / sqrt(list_dot_product(v, v) / len(v) - m * m) + 1, 5) AS layer FROM n")
def unit_and_layernorm(spark: SparkSession, d: str) -> DataFrame:
    """First component of the unit vector, and of a layer norm taken from the unit vector: the norm of the input does not enter."""
    e = T.read(spark, d, "embeddings").select("vec_id", VE.unit(F.col("embedding").cast("array<double>")).alias("u"))
    wide = lambda x: F.transform("u", lambda _: F.lit(x))
    return e.select("vec_id", F.round(F.col("u")[0], 6).alias("unit"), F.round(VE.layernorm(F.col("u"), wide(2.0), wide(1.0))[0], 5).alias("layer"))


# ------------------------------------------------------- evaluation of windows

_EVAL = f"""pose AS ({C.oracle_sql()["pose_metrics"]}), fov AS (SELECT "window", fov_err_deg FROM ({C.oracle_sql()["camera_loss"]})), depth AS ({C.oracle_sql()["depth_metrics"]}),
records AS (SELECT pose.*, fov_err_deg, coalesce(abs_rel, 'NaN'::DOUBLE) AS abs_rel, coalesce(delta, 'NaN'::DOUBLE) AS delta, coalesce(scale_ratio, 'NaN'::DOUBLE) AS scale_ratio FROM pose JOIN fov USING ("window") LEFT JOIN depth ON depth.supp = pose."window")"""
_POSE_COLUMNS = {"rot_mean": 5, "rot_median": 5, "trans_mean": 5, "trans_median": 5, "rra_at_5": 6, "rta_at_5": 6, "auc_at_30": 6, "fov_err_deg": 5, "scale_ratio": 6, "abs_rel": 9, "delta": 6}


def _records(spark: SparkSession, d: str) -> DataFrame:
    px = T.observations(spark, d).withColumn("pred", F.col("z") * (1 - F.col("discount")) * (1 + F.col("tax"))).withColumnRenamed("supp", "window")
    got = M.window_metrics(T.poses(spark, d), px, "window", "vec_id", "pred", "z")
    return got.select("window", "pairs", *[_r(c, n) for c, n in _POSE_COLUMNS.items()])


@query(f'WITH {_EVAL} SELECT "window", pairs, {", ".join(_POSE_COLUMNS)} FROM records')
def window_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Pose, field-of-view and depth metrics of each window; suppliers stand for the windows that have depth."""
    return _records(spark, d)


@query(f"""WITH {_EVAL}, long AS (UNPIVOT (SELECT pairs::DOUBLE AS pairs, {", ".join(_POSE_COLUMNS)} FROM records) ON COLUMNS(*) INTO NAME metric VALUE x),
means AS (SELECT metric, avg(x) AS mean, count(*)::DOUBLE AS n FROM long WHERE isfinite(x) GROUP BY metric),
pooled AS (WITH {C._PAIR_ERRORS} SELECT avg(list_sum(list_transform(range(1, 31), lambda k: (greatest(rot, trans) < k)::INTEGER))) / 30 AS auc_at_30, avg((rot < 5)::INTEGER) AS rra_at_5, avg((trans < 5)::INTEGER) AS rta_at_5, avg((rot < 15)::INTEGER) AS rra_at_15, avg((trans < 15)::INTEGER) AS rta_at_15,
 avg(rot) AS rot_err_deg_mean, avg(trans) AS trans_err_deg_mean, count(*)::DOUBLE AS num_pairs, quantile_disc(rot, 0.5) AS rot_err_deg_median, quantile_disc(trans, 0.5) AS trans_err_deg_median FROM err),
counts AS (SELECT count(*)::DOUBLE AS num_windows, (count(*) FILTER (WHERE NOT isfinite(abs_rel)))::DOUBLE AS num_windows_no_depth FROM records)
SELECT metric, round(value, 4) AS value FROM (SELECT 'window_' || metric AS metric, mean AS value FROM means UNION ALL SELECT 'window_' || metric || '_n', n FROM means UNION ALL (UNPIVOT pooled ON COLUMNS(*) INTO NAME metric VALUE value) UNION ALL (UNPIVOT counts ON COLUMNS(*) INTO NAME metric VALUE value))""")
def evaluation_summary(spark: SparkSession, d: str) -> DataFrame:
    """Means over windows, statistics of all pairs and counts, as the run's summary."""
    return M.summarise(_records(spark, d), C._errors(spark, d), ["window"]).select("metric", _r("value", 4))


@query(f"""WITH {C._GRID}, g AS (SELECT (y // 25)::BIGINT AS image, y, x, z * x / 100.0 AS e, 1 + y / 50.0 AS conf, z > 940 AS ok FROM grid),
w AS (SELECT image, conf * abs(e - lag(e) OVER h) AS s, ok AND lag(ok) OVER h AND lag(x) OVER h = x - 1 AS pair FROM g WINDOW h AS (PARTITION BY image, y ORDER BY x)), v AS (SELECT image, conf * abs(e - lag(e) OVER h) AS s, ok AND lag(ok) OVER h AND lag(y) OVER h = y - 1 AS pair FROM g WINDOW h AS (PARTITION BY image, x ORDER BY y)),
a AS (SELECT image, avg(s) AS grad_w FROM w WHERE pair GROUP BY image), b AS (SELECT image, avg(s) AS grad_h FROM v WHERE pair GROUP BY image)
SELECT image, round(coalesce(grad_w, 0), 5) AS grad_w, round(coalesce(grad_h, 0), 5) AS grad_h, round(coalesce(grad_w, 0) + coalesce(grad_h, 0), 5) AS loss_grad FROM (SELECT DISTINCT image FROM g) LEFT JOIN a USING (image) LEFT JOIN b USING (image)""")
def gradient_loss(spark: SparkSession, d: str) -> DataFrame:
    """The step term of the dense loss on grids of part prices."""
    px = C._grid(spark, d).select(F.floor(F.col("y") / 25).cast("bigint").alias("image"), "y", "x", "z", (F.col("z") * (1 + F.col("x") / 100)).alias("pred"), (1 + F.col("y") / 50).alias("conf"))
    return M.gradient_loss(px, ["image"], "y", "x", "pred", "z", "conf", F.col("z") > 940).select("image", *[_r(c, 5) for c in ("grad_w", "grad_h", "loss_grad")])


@query("WITH r AS (SELECT event_type AS metric, value AS x FROM events UNION ALL SELECT 'k', json_extract_string(props, '$.k')::DOUBLE FROM events) SELECT metric, round(avg(x), 6) AS mean, count(*) AS n FROM r WHERE isfinite(x) GROUP BY metric")
def means_of_records(spark: SparkSession, d: str) -> DataFrame:
    """Finite means of all metrics that any record names."""
    rows = T.eval_window(spark, d).select(F.create_map(F.col("run"), F.col("value"), F.lit("k"), F.col("k")).alias("metrics"))
    return A.means_of_records(rows, "metrics").select("metric", _r("mean"), "n")


@query(f"""WITH {C._XY}, pr AS (SELECT count(*) AS n, corr(x, y) AS r FROM xy), st AS (SELECT n, n - 2 AS df, abs(r) * sqrt(n - 2) / sqrt(1 - r * r) AS t FROM pr), b AS (SELECT n, df, least(pi() / 2, 40 / sqrt(df)) AS hi, atan(t / sqrt(df)) AS lo FROM st), k AS (SELECT (unnest(range(0, 20000)) + 0.5) / 20000 AS k)
SELECT any_value(n) AS n, round(sum(exp((df - 1) * ln(cos(lo + (hi - lo) * k)))) * any_value(hi - lo) / (sum(exp((df - 1) * ln(cos(hi * k)))) * any_value(hi)), 5) AS p FROM b, k""")
def regression_p_value(spark: SparkSession, d: str) -> DataFrame:
    """p-value of the slope of loss on typicality."""
    got = ST.regression(C._typicality_loss(spark, d), "x", "y")
    return got.select("n", F.round(ST.p_value(F.col("t"), F.col("n") - 2), 5).alias("p"))

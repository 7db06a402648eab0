"""The relational catalogue: each query beside the DuckDB statement that gives the same rows.

Every query reads whole tables. Floats are rounded the same way on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import rotation as R
from lumenfold.functions import scalar as S
from lumenfold.operators import aggregates as A
from lumenfold.operators import clustering as C
from lumenfold.operators import filters as P
from lumenfold.operators import geometry as G
from lumenfold.operators import joins as J
from lumenfold.operators import metrics as M
from lumenfold.operators import sampling as SA
from lumenfold.operators import stats as ST
from lumenfold.operators import vectors as V
from lumenfold.operators import windows as W

from . import tables as T

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


# Statement parts that several queries share.
_FEATURE = "feature AS (SELECT vec_id // 4 AS scene, vec_id % 4 AS img_no, embedding::DOUBLE[] AS cls, label AS cluster FROM embeddings), members AS (SELECT cluster, scene FROM feature WHERE img_no = 0)"
_VALUES = "vals AS (SELECT user_id AS scene, avg(value) AS value, count(*) AS repeats FROM events WHERE value IS NOT NULL AND isfinite(value) GROUP BY user_id)"
_OBS = "obs AS (SELECT l_orderkey AS frame, l_partkey AS point, l_linenumber AS line, l_extendedprice AS z, l_quantity AS error, l_discount AS discount, l_tax AS tax, l_suppkey AS supp FROM lineitem)"
_SCENES = "scenes AS (SELECT d.lang AS subset, d.doc_id AS scene, d.n_chars AS num_frames, l.quality = 1 AS has_depth FROM documents d LEFT JOIN labels l USING (doc_id))"
# Layer de-meaning and scene centroids, long form.
_UNITS = f"""{_FEATURE},
long0 AS (SELECT scene, img_no, unnest(range(64)) AS d, unnest(cls) AS x FROM feature),
mu AS (SELECT d, avg(x) AS m FROM long0 GROUP BY d),
cen AS (SELECT scene, img_no, l.d, x - m AS x FROM long0 l JOIN mu USING (d)),
lay AS (SELECT scene, img_no, d, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY scene, img_no, d // 16)), 1e-12) AS x FROM cen),
units AS (SELECT scene, img_no, d, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY scene, img_no)), 1e-12) AS x FROM lay)"""
_CENTROIDS = f"{_UNITS}, centroids AS (SELECT scene, d, avg(x) AS c FROM units GROUP BY scene, d), cen_c AS (SELECT cluster, scene, d, c FROM centroids JOIN members USING (scene))"


def _ready(spark: SparkSession, d: str) -> DataFrame:
    """scene, centroid, cluster."""
    f = T.feature(spark, d)
    return V.scene_centroids(f, ["scene"], "cls", T.N_LAYERS, T.LAYER_WIDTH).join(T.members(spark, d), "scene")


# ------------------------------------------------------------ dataset assembly


@query(f"WITH {_SCENES} SELECT subset, scene, num_frames, concat_ws('/', subset, scene) AS path FROM scenes WHERE coalesce(has_depth, false) AND coalesce(num_frames, 0) >= 500")
def scene_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = P.min_frames(P.dense_only(T.scenes(spark, d), "depth"), 500)
    return rows.select("subset", "scene", "num_frames", F.concat_ws("/", "subset", F.col("scene").cast("string")).alias("path"))


@query("WITH s AS (SELECT p_size, p_brand, count(*) AS n FROM part GROUP BY ALL), b AS (SELECT p_size, p_brand FROM s ORDER BY n DESC, p_size, p_brand LIMIT 1) SELECT p_partkey, p_size, p_brand FROM part JOIN b USING (p_size, p_brand)")
def modal_shape_smallest(spark: SparkSession, d: str) -> DataFrame:
    return P.modal_shape(T.read(spark, d, "part"), ["p_size", "p_brand"]).select("p_partkey", "p_size", "p_brand")


@query("WITH s AS (SELECT p_size, p_brand, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY ALL), b AS (SELECT p_size, p_brand FROM s ORDER BY n DESC, f LIMIT 1) SELECT p_partkey, p_size, p_brand FROM part JOIN b USING (p_size, p_brand)")
def modal_shape_first(spark: SparkSession, d: str) -> DataFrame:
    return P.modal_shape(T.read(spark, d, "part"), ["p_size", "p_brand"], order="p_partkey").select("p_partkey", "p_size", "p_brand")


@query("WITH j AS (SELECT coalesce(d.doc_id, l.doc_id) AS k, CASE WHEN d.doc_id IS NULL THEN 'no_images' WHEN l.doc_id IS NULL THEN 'no_model' ELSE 'ok' END AS status FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)) SELECT status, count(*) AS n FROM j GROUP BY status")
def status_histogram(spark: SparkSession, d: str) -> DataFrame:
    return A.histogram(J.discover(T.read(spark, d, "documents"), T.read(spark, d, "labels"), ["doc_id"]), "status")


@query(f"WITH {_SCENES} SELECT subset, scene, CASE WHEN coalesce(num_frames, 0) < 200 THEN 'too_few_frames' WHEN has_depth IS NULL THEN 'no_depth' WHEN NOT has_depth THEN 'bad_depth' END AS reason, CASE WHEN coalesce(num_frames, 0) < 200 OR has_depth IS NULL OR NOT has_depth THEN 'skip' ELSE 'ok' END AS status FROM scenes")
def scene_gates(spark: SparkSession, d: str) -> DataFrame:
    gates = [("too_few_frames", F.coalesce("num_frames", F.lit(0)) < 200), ("no_depth", F.col("has_depth").isNull()), ("bad_depth", ~F.col("has_depth"))]
    return P.scene_gates(T.scenes(spark, d), gates).select("subset", "scene", "reason", "status")


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY ALL)
SELECT o_orderkey, coalesce(a.p, b.p, c.p) AS match_value, CASE WHEN a.p IS NOT NULL THEN 0 WHEN b.p IS NOT NULL THEN 1 ELSE 2 END AS match_place
FROM orders LEFT JOIN f a ON a.l_orderkey = o_orderkey AND a.l_linenumber = 1 LEFT JOIN f b ON b.l_orderkey = o_orderkey AND b.l_linenumber = 2 LEFT JOIN f c ON c.l_orderkey = o_orderkey AND c.l_linenumber = 3
WHERE coalesce(a.p, b.p, c.p) IS NOT NULL""")
def fallback_match(spark: SparkSession, d: str) -> DataFrame:
    files = T.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber").agg(F.min("l_partkey").alias("p"))
    return J.match_fallback(T.read(spark, d, "orders").select("o_orderkey"), files, "o_orderkey", [F.lit(1), F.lit(2), F.lit(3)], F.col("l_linenumber"), "p")


@query(f"WITH {_OBS}, g AS (SELECT frame, count(*) FILTER (WHERE error <= 25 AND line >= 2) AS good FROM obs GROUP BY frame) SELECT frame, point, line FROM obs JOIN g USING (frame) WHERE CASE WHEN good >= 2 THEN error <= 25 AND line >= 2 ELSE line >= 1 END")
def point_quality_fallback(spark: SparkSession, d: str) -> DataFrame:
    return P.point_quality(T.observations(spark, d), "frame", "error", "line", 25, 2, 2, 1).select("frame", "point", "line")


@query(f"WITH {_OBS} SELECT frame, point, line FROM obs WHERE frame IN (SELECT frame FROM obs GROUP BY frame HAVING count(*) >= 4)")
def min_observations(spark: SparkSession, d: str) -> DataFrame:
    return P.min_observations(T.observations(spark, d), ["frame"], 4).select("frame", "point", "line")


@query(f"WITH {_OBS} SELECT frame, point, line FROM obs QUALIFY row_number() OVER (PARTITION BY frame ORDER BY error, point, line, supp, z) <= 3")
def obs_topk_per_frame(spark: SparkSession, d: str) -> DataFrame:
    return W.top_per_group(T.observations(spark, d), ["frame"], 3, *[F.asc(c) for c in ("error", "point", "line", "supp", "z")]).select("frame", "point", "line")


@query(f"WITH {_OBS} SELECT frame, point, line, (dense_rank() OVER (PARTITION BY frame ORDER BY point) - 1)::INTEGER AS local FROM obs")
def dense_rekey(spark: SparkSession, d: str) -> DataFrame:
    return W.dense_rekey(T.observations(spark, d), ["frame"], "point", "local").select("frame", "point", "line", "local")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) % 3 = 0")
def frame_stride(spark: SparkSession, d: str) -> DataFrame:
    return P.every_nth(T.read(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 3).select("o_custkey", "o_orderkey")


@query(f"""WITH {_OBS}, seen AS (SELECT DISTINCT frame, point FROM obs), n AS (SELECT frame, count(*) AS n FROM seen GROUP BY frame),
p AS (SELECT a.frame AS fi, b.frame AS fj, count(*) AS shared FROM seen a JOIN seen b ON a.point = b.point AND a.frame < b.frame GROUP BY ALL HAVING count(*) >= 2)
SELECT fi, fj, shared, round(shared / least(i.n, j.n), 6) AS overlap FROM p JOIN n i ON i.frame = fi JOIN n j ON j.frame = fj""")
def covisibility(spark: SparkSession, d: str) -> DataFrame:
    return J.covisibility(T.observations(spark, d), "frame", "point", min_shared=2).select("fi", "fj", "shared", _r("overlap"))


@query("WITH c AS (SELECT DISTINCT p_partkey AS point FROM part WHERE p_size <= 25) SELECT l_orderkey AS frame, point, l_linenumber AS line FROM lineitem JOIN c ON l_partkey = point")
def observed_points(spark: SparkSession, d: str) -> DataFrame:
    kept = T.read(spark, d, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("point"))
    return J.keep_observed(T.observations(spark, d), kept, "point").select("frame", "point", "line")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_scene_list(spark: SparkSession, d: str) -> DataFrame:
    return J.in_list(T.read(spark, d, "documents"), T.read(spark, d, "labels"), ["doc_id"]).select("doc_id", "lang")


@query(f"WITH {_FEATURE} SELECT DISTINCT user_id AS scene FROM events WHERE user_id NOT IN (SELECT scene FROM members)")
def anti_unscored(spark: SparkSession, d: str) -> DataFrame:
    return J.not_in_list(T.eval_window(spark, d).select("scene").distinct(), T.members(spark, d), ["scene"])


@query("SELECT d.doc_id, d.lang, coalesce(l.quality, -1) AS num_depth, l.doc_id IS NOT NULL AS touched FROM documents d LEFT JOIN labels l USING (doc_id)")
def index_upsert(spark: SparkSession, d: str) -> DataFrame:
    index = T.read(spark, d, "documents").select("doc_id", "lang").withColumns({"num_depth": F.lit(-1), "touched": F.lit(False)})
    tried = T.read(spark, d, "labels").select("doc_id", F.col("quality").alias("num_depth"), F.lit(True).alias("touched"))
    return J.upsert(index, tried, ["doc_id"], ["num_depth", "touched"]).select("doc_id", "lang", "num_depth", "touched")


@query("SELECT count(*) FILTER (WHERE lang = 'en') AS num_train, count(*) FILTER (WHERE lang <> 'en') AS num_val, sum(coalesce(n_chars, 0))::BIGINT AS frames FROM documents")
def split_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = T.scenes(spark, d).withColumn("split", F.when(F.col("subset") == "en", "train").otherwise("val"))
    return A.split_counts(rows)


# -------------------------------------------------------------- cluster reports


@query(f"WITH {_VALUES} SELECT scene, round(value, 6) AS value, repeats FROM vals")
def scene_metric_mean(spark: SparkSession, d: str) -> DataFrame:
    return A.mean_of_repeats(T.eval_window(spark, d), "scene", "value").select("scene", _r("value"), "repeats")


@query(f"WITH {_VALUES} SELECT count(*) AS scenes, min(repeats) AS least, max(repeats) AS most FROM vals")
def repeat_range(spark: SparkSession, d: str) -> DataFrame:
    return A.repeat_range(A.mean_of_repeats(T.eval_window(spark, d), "scene", "value"))


_REPORT = f"""{_FEATURE}, {_VALUES}, report AS (SELECT cluster, count(*) AS size, count(value) AS n, count(*) - count(value) AS missing, avg(value) AS mean, median(value) AS median,
 CASE WHEN count(value) = 1 THEN 0.0 ELSE stddev_samp(value) END AS std, min(value) AS min, max(value) AS max FROM members LEFT JOIN vals USING (scene) GROUP BY cluster)"""


@query(f"WITH {_REPORT} SELECT cluster, size, n, missing, round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std, round(min, 6) AS min, round(max, 6) AS max FROM report")
def cluster_loss_report(spark: SparkSession, d: str) -> DataFrame:
    values = A.mean_of_repeats(T.eval_window(spark, d), "scene", "value")
    got = A.cluster_report(T.members(spark, d), values)
    return got.select("cluster", "size", "n", "missing", *[_r(c) for c in ("mean", "median", "std", "min", "max")])


@query(f"WITH {_REPORT}, k AS (SELECT *, row_number() OVER (ORDER BY round(mean, 9) DESC, cluster) AS place, row_number() OVER (ORDER BY round(mean, 9), cluster DESC) AS back, count(*) OVER () AS total FROM report WHERE mean IS NOT NULL) SELECT cluster, n, round(mean, 6) AS mean, place::INTEGER AS place FROM k WHERE place <= 10 OR (total > 15 AND back <= 5)")
def worst_best_clusters(spark: SparkSession, d: str) -> DataFrame:
    """The console table: the worst ten clusters, and the best five only beyond fifteen."""
    values = A.mean_of_repeats(T.eval_window(spark, d), "scene", "value")
    got = A.cluster_report(T.members(spark, d), values).filter("mean is not null").withColumn("_m", F.round("mean", 9))
    n = got.agg(F.count("*").alias("_total"))
    top = got.orderBy(F.desc("_m"), "cluster").limit(10)
    # A cluster's place is the number of clusters before it: a join of reports, whose rows are the clusters.
    low = got.orderBy(F.asc("_m"), F.desc("cluster")).limit(5).crossJoin(F.broadcast(n)).filter("_total > 15").drop("_total")
    shown = top.unionByName(low).dropDuplicates(["cluster"])
    before = got.select(F.col("_m").alias("_bm"), F.col("cluster").alias("_bc"))
    ahead = (F.col("_bm") > F.col("_m")) | ((F.col("_bm") == F.col("_m")) & (F.col("_bc") < F.col("cluster")))
    placed = before.join(F.broadcast(shown), ahead, "inner").groupBy("cluster").agg(F.count("*").alias("_b"))  # shown: fifteen rows at most
    return shown.join(placed, "cluster", "left").select("cluster", "n", _r("mean"), (F.coalesce("_b", F.lit(0)) + 1).cast("int").alias("place"))


@query(f"WITH {_VALUES} SELECT count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(min(value), 6) AS min, round(max(value), 6) AS max, round(quantile_cont(value, 0.02), 6) AS vmin, round(quantile_cont(value, 0.98), 6) AS vmax FROM vals")
def overall_summary(spark: SparkSession, d: str) -> DataFrame:
    got = A.overall(A.mean_of_repeats(T.eval_window(spark, d), "scene", "value"))
    return got.select("n", *[_r(c) for c in ("mean", "median", "min", "max", "vmin", "vmax")])


_STEPS = "[" + ", ".join("[" + ", ".join(str(float(int(c[1 + 2 * k : 3 + 2 * k], 16))) for k in range(3)) + "]" for c in S.RAMP) + "]"


@query(f"""WITH {_VALUES}, o AS (SELECT quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM vals),
t AS (SELECT scene, round((value - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 9) AS t FROM vals, o),
p AS (SELECT scene, t, least(greatest(t, 0), 1) * 12 AS place, {_STEPS} AS ramp FROM t),
q AS (SELECT scene, t, ramp, least(floor(place)::INTEGER, 11) AS low, place - least(floor(place)::INTEGER, 11) AS share FROM p)
SELECT scene, round(t, 5) AS t, '#' || printf('%02x%02x%02x', round_even(ramp[low+1][1] * (1 - share) + ramp[low+2][1] * share, 0)::INTEGER, round_even(ramp[low+1][2] * (1 - share) + ramp[low+2][2] * share, 0)::INTEGER, round_even(ramp[low+1][3] * (1 - share) + ramp[low+2][3] * share, 0)::INTEGER) AS colour FROM q""")
def colour_scale_ramp(spark: SparkSession, d: str) -> DataFrame:
    values = A.mean_of_repeats(T.eval_window(spark, d), "scene", "value")
    scale = A.overall(values).select("vmin", "vmax")
    t = values.crossJoin(F.broadcast(scale)).select("scene", F.round(S.on_scale(F.col("value"), F.col("vmin"), F.col("vmax")), 9).alias("t"))  # one row
    return t.select("scene", _r("t", 5), S.colour(F.col("t")).alias("colour"))


_METRICS = "m AS (SELECT event_type AS run, CASE WHEN value < 5 THEN 'NaN'::DOUBLE ELSE value END AS loss, CASE WHEN value > 200 THEN NULL ELSE json_extract_string(props, '$.k')::DOUBLE END AS k FROM events)"


def _metric_rows(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation rows with NaN and null metrics."""
    e = T.eval_window(spark, d)
    return e.select("run", F.when(F.col("value") < 5, F.lit(float("nan"))).otherwise(F.col("value")).alias("loss"), F.when(F.col("value") <= 200, F.col("k")).alias("k"))


@query(f"WITH {_METRICS} SELECT run, 'loss' AS metric, round(avg(loss), 6) AS mean, count(*) AS n FROM m WHERE isfinite(loss) GROUP BY run UNION ALL SELECT run, 'k', round(avg(k), 6), count(*) FROM m WHERE isfinite(k) GROUP BY run")
def finite_metric_summary(spark: SparkSession, d: str) -> DataFrame:
    return A.finite_means(_metric_rows(spark, d), ["loss", "k"], ["run"]).select("run", "metric", _r("mean"), "n")


@query(f"WITH {_METRICS} SELECT count(*) AS windows, count(*) FILTER (WHERE NOT coalesce(isfinite(loss), false)) AS without FROM m")
def window_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.window_counts(_metric_rows(spark, d), "loss")


@query(f"WITH {_METRICS} SELECT round(sum(CASE WHEN isfinite(loss) THEN loss ELSE 0 END) / count(*), 6) AS loss, round(sum(CASE WHEN isfinite(k) THEN k ELSE 0 END) / count(*), 6) AS k FROM m")
def validation_means(spark: SparkSession, d: str) -> DataFrame:
    return A.biased_means(_metric_rows(spark, d), ["loss", "k"]).select(_r("loss"), _r("k"))


@query(f"WITH {_METRICS}, s AS (SELECT run, loss FROM m) SELECT run, isnan(avg(loss)) AS broken, count(*) AS repeats FROM s GROUP BY run")
def strict_metric_mean(spark: SparkSession, d: str) -> DataFrame:
    """One NaN repeat makes a strict mean NaN."""
    got = A.mean_of_repeats(_metric_rows(spark, d), "run", "loss", strict=True)
    return got.select("run", F.isnan("value").alias("broken"), "repeats")


@query(f"""WITH {_SCENES}, f AS (SELECT coalesce(has_depth, false) AS dense, num_frames FROM scenes)
SELECT 'all' AS part, count(*) AS n, round(avg(num_frames), 6) AS frames FROM f UNION ALL
SELECT CASE WHEN dense THEN 'true' ELSE 'false' END, count(*), round(avg(num_frames), 6) FROM f WHERE (SELECT count(DISTINCT dense) FROM f) = 2 GROUP BY dense""")
def dense_sparse_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = T.scenes(spark, d).withColumn("dense", F.coalesce("has_depth", F.lit(False)))
    return A.split_summary(rows, "dense", [F.count("*").alias("n"), F.avg("num_frames").alias("frames")]).select("part", "n", _r("frames"))


@query(f"WITH {_REPORT} SELECT cluster, round(mean / max(mean) OVER (), 6) AS bar FROM report")
def relative_to_worst(spark: SparkSession, d: str) -> DataFrame:
    values = A.mean_of_repeats(T.eval_window(spark, d), "scene", "value")
    return W.relative_to_max(A.cluster_report(T.members(spark, d), values), "mean", "bar").select("cluster", _r("bar"))


# -------------------------------------------------------- vectors and clusters


@query(f"WITH {_UNITS} SELECT scene, img_no::INTEGER AS img_no, d::INTEGER AS dim, round(x, 6) + 0.0 AS x FROM units")
def layer_demean_normalise(spark: SparkSession, d: str) -> DataFrame:
    rows = V.demean_layers(T.feature(spark, d), "cls", T.N_LAYERS, T.LAYER_WIDTH)
    return rows.select("scene", "img_no", F.posexplode("cls").alias("dim", "x")).select("scene", "img_no", "dim", (F.round("x", 6) + 0.0).alias("x"))


@query(f"WITH {_CENTROIDS} SELECT scene, d::INTEGER AS dim, round(c, 6) + 0.0 AS c FROM centroids")
def scene_centroids(spark: SparkSession, d: str) -> DataFrame:
    rows = V.scene_centroids(T.feature(spark, d), ["scene"], "cls", T.N_LAYERS, T.LAYER_WIDTH)
    return rows.select("scene", F.posexplode("centroid").alias("dim", "c")).select("scene", "dim", (F.round("c", 6) + 0.0).alias("c"))


_PAIRS = f"{_CENTROIDS}, vec AS (SELECT cluster, scene, list(c ORDER BY d) AS v FROM cen_c GROUP BY ALL)"


@query(f"""WITH {_PAIRS}, sims AS (SELECT a.cluster, list_dot_product(a.v, b.v) AS s FROM vec a JOIN vec b ON a.cluster = b.cluster AND a.scene < b.scene),
sizes AS (SELECT cluster, count(*) AS size FROM vec GROUP BY cluster), co AS (SELECT cluster, avg(s) AS cohesion FROM sims GROUP BY cluster)
SELECT cluster, size, round(cohesion, 6) AS cohesion FROM sizes LEFT JOIN co USING (cluster)""")
def cluster_cohesion(spark: SparkSession, d: str) -> DataFrame:
    return V.cohesion(_ready(spark, d), "cluster").select("cluster", "size", _r("cohesion"))


_TYPICALITY = f"""{_PAIRS}, t AS (SELECT a.cluster, a.scene, coalesce(avg(list_dot_product(a.v, b.v)) FILTER (WHERE a.scene <> b.scene), 0) AS typicality FROM vec a JOIN vec b ON a.cluster = b.cluster GROUP BY ALL)"""


@query(f"WITH {_TYPICALITY} SELECT cluster, scene, round(typicality, 6) AS typicality, (row_number() OVER (PARTITION BY cluster ORDER BY round(typicality, 9), scene) - 1)::INTEGER AS ordinal FROM t")
def typicality_rank(spark: SparkSession, d: str) -> DataFrame:
    rows = V.typicality(_ready(spark, d), "cluster").withColumn("_t", F.round("typicality", 9))
    return W.ordinal(rows, ["cluster"], F.asc("_t"), F.asc("scene")).select("cluster", "scene", _r("typicality"), "ordinal")


_CENTRES = f"{_CENTROIDS}, raw_c AS (SELECT cluster AS option, d, avg(c) AS y FROM cen_c GROUP BY ALL)"


def _nearest_sql(centres: str) -> str:
    return f"""WITH {_CENTRES}, ctr AS ({centres}),
sc AS (SELECT scene, option, round(sum(c * y), 9) AS score FROM centroids JOIN ctr USING (d) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY score DESC, option) AS k FROM sc)
SELECT a.scene, a.option AS best, round(a.score, 6) AS best_score, b.option AS second, round(b.score, 6) AS second_score, round(a.score - b.score, 6) AS margin FROM rk a LEFT JOIN rk b ON a.scene = b.scene AND b.k = 2 WHERE a.k = 1"""


_UNIT_CENTRES = "SELECT option, d, y / greatest(sqrt(sum(y * y) OVER (PARTITION BY option)), 1e-12) AS y FROM raw_c"


def _nearest(spark: SparkSession, d: str, score: str) -> DataFrame:
    rows = _ready(spark, d)
    return V.nearest_cluster(rows, ["scene"], V.cluster_centroids(rows, "cluster", score=score), "cluster")


@query(_nearest_sql(_UNIT_CENTRES))
def nearest_cluster_unit(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d, "unit").select("scene", "best", _r("best_score"), "second", _r("second_score"), _r("margin"))


@query(_nearest_sql("SELECT * FROM raw_c"))
def nearest_cluster_mean(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d, "mean").select("scene", "best", _r("best_score"), "second", _r("second_score"), _r("margin"))


_PREDICTED = f"""{_CENTRES}, ctr AS ({_UNIT_CENTRES}), sc AS (SELECT scene, option, round(sum(c * y), 9) AS score FROM centroids JOIN ctr USING (d) GROUP BY ALL),
pred AS (SELECT scene, option AS best FROM sc QUALIFY row_number() OVER (PARTITION BY scene ORDER BY score DESC, option) = 1), both AS (SELECT scene, best, cluster FROM pred JOIN members USING (scene))"""


@query(f"WITH {_PREDICTED.replace('both AS', 'bothp AS')} SELECT count(*) AS n, round(avg((best = cluster)::INTEGER), 6) AS recovery FROM bothp")
def self_recovery(spark: SparkSession, d: str) -> DataFrame:
    rows = _nearest(spark, d, "unit").join(T.members(spark, d), "scene")
    return rows.agg(F.count("*").alias("n"), F.round(F.avg((F.col("best") == F.col("cluster")).cast("double")), 6).alias("recovery"))


@query(f"WITH {_PREDICTED.replace('both AS', 'bothp AS')}, a AS (SELECT cluster, count(*) AS n_true FROM bothp GROUP BY 1), b AS (SELECT best AS cluster, count(*) AS n_pred FROM bothp GROUP BY 1) SELECT cluster, coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0) AS n_pred, coalesce(n_pred, 0) - coalesce(n_true, 0) AS drift FROM a FULL JOIN b USING (cluster)")
def size_drift(spark: SparkSession, d: str) -> DataFrame:
    rows = _nearest(spark, d, "unit").join(T.members(spark, d), "scene")
    true, pred = rows.groupBy("cluster").agg(F.count("*").alias("n_true")), rows.groupBy(F.col("best").alias("cluster")).agg(F.count("*").alias("n_pred"))
    both = true.join(pred, "cluster", "full").select("cluster", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_true", "n_pred")])
    return both.withColumn("drift", F.col("n_pred") - F.col("n_true"))


@query(f"""WITH {_PAIRS}, w AS (SELECT a.cluster AS ca, b.cluster AS cb, a.scene AS i, list_dot_product(a.v, b.v) + 1 AS w FROM vec a JOIN vec b ON a.scene <> b.scene),
k AS (SELECT i, any_value(ca) AS cluster, sum(w) AS k FROM w GROUP BY i), t AS (SELECT sum(w) AS two_w FROM w),
inside AS (SELECT ca AS cluster, sum(w) FILTER (WHERE ca = cb) AS w_in FROM w GROUP BY ca), ks AS (SELECT cluster, sum(k) AS k FROM k GROUP BY cluster)
SELECT round(sum(coalesce(w_in, 0) / two_w - g * (k / two_w) * (k / two_w)), 6) AS modularity, g AS gamma FROM inside JOIN ks USING (cluster), t, (SELECT unnest([1.0::DOUBLE, 2.0::DOUBLE]) AS g) GROUP BY g""")
def modularity_fixed(spark: SparkSession, d: str) -> DataFrame:
    rows = _ready(spark, d)
    return V.modularity(rows, "cluster", gamma=1.0).withColumn("gamma", F.lit(1.0)).unionByName(V.modularity(rows, "cluster", gamma=2.0).withColumn("gamma", F.lit(2.0))).select(_r("modularity"), "gamma")


def _ordinals(spark: SparkSession, d: str) -> DataFrame:
    rows = V.typicality(_ready(spark, d), "cluster").withColumn("_t", F.round("typicality", 9))
    return W.ordinal(rows, ["cluster"], F.asc("_t"), F.asc("scene"))


_ORD = f"{_TYPICALITY}, o AS (SELECT cluster, scene, row_number() OVER (PARTITION BY cluster ORDER BY round(typicality, 9), scene) - 1 AS ordinal, count(*) OVER (PARTITION BY cluster) AS size FROM t)"


@query(f"WITH {_ORD} SELECT cluster, scene, ordinal::INTEGER AS ordinal FROM o WHERE size >= 3 AND ordinal < 5")
def subset_k(spark: SparkSession, d: str) -> DataFrame:
    return C.select_subset(_ordinals(spark, d), "cluster", "ordinal", min_size=3, k=5).select("cluster", "scene", "ordinal")


@query(f"WITH {_ORD} SELECT cluster, scene, ordinal::INTEGER AS ordinal FROM o WHERE size >= 3 AND ordinal < least(size, greatest(1, round_even(size * 25.0 / 100.0, 0)::INTEGER))")
def subset_pct(spark: SparkSession, d: str) -> DataFrame:
    return C.select_subset(_ordinals(spark, d), "cluster", "ordinal", min_size=3, percent=25.0).select("cluster", "scene", "ordinal")


@query(f"""WITH {_TYPICALITY}, {_VALUES}, s AS (SELECT cluster, scene, typicality, CASE WHEN scene % 5 = 0 THEN 'eval' ELSE 'train' END AS split FROM t)
SELECT cluster, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'eval') AS n_eval, round(avg(typicality) FILTER (WHERE split = 'train'), 6) AS typ_train, round(avg(typicality) FILTER (WHERE split = 'eval'), 6) AS typ_eval,
 count(value) FILTER (WHERE split = 'eval') AS n_scored, round(avg(value) FILTER (WHERE split = 'eval'), 6) AS mean FROM s LEFT JOIN vals USING (scene) GROUP BY cluster""")
def joint_union_report(spark: SparkSession, d: str) -> DataFrame:
    """Train and eval scenes clustered together: sizes, typicality by split, loss of eval scenes."""
    rows = _ready(spark, d)
    both = J.tag_union(rows.filter("scene % 5 <> 0"), rows.filter("scene % 5 = 0"))
    scored = V.typicality(both, "cluster").join(A.mean_of_repeats(T.eval_window(spark, d), "scene", "value").select("scene", "value"), "scene", "left")
    of = lambda split, x: F.when(F.col("split") == split, F.col(x))
    return scored.groupBy("cluster").agg(
        F.count(of("train", "scene")).alias("n_train"), F.count(of("eval", "scene")).alias("n_eval"), F.round(F.avg(of("train", "typicality")), 6).alias("typ_train"), F.round(F.avg(of("eval", "typicality")), 6).alias("typ_eval"),
        F.count(of("eval", "value")).alias("n_scored"), F.round(F.avg(of("eval", "value")), 6).alias("mean"),
    )


# ------------------------------------------------------------------ statistics


_RANKED = "SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM xy"


@query(f"WITH {_REPORT}, xy AS (SELECT size AS x, round(mean, 9) AS y FROM report WHERE mean IS NOT NULL), r AS ({_RANKED}) SELECT count(*) AS n, round(CASE WHEN count(*) < 3 THEN 'NaN'::DOUBLE ELSE corr(rx, ry) END, 6) AS rho FROM r")
def spearman_size_loss(spark: SparkSession, d: str) -> DataFrame:
    values = A.mean_of_repeats(T.eval_window(spark, d), "scene", "value")
    rows = A.cluster_report(T.members(spark, d), values).filter("mean is not null").select("size", F.round("mean", 9).alias("mean"))
    return ST.spearman(rows, "size", "mean").select("n", _r("rho"))


@query("WITH xy AS (SELECT o_totalprice AS x, l_extendedprice AS y FROM orders JOIN lineitem ON l_orderkey = o_orderkey), r AS (" + _RANKED + ") SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r")
def spearman_price(spark: SparkSession, d: str) -> DataFrame:
    rows = T.read(spark, d, "orders").join(T.read(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_totalprice").alias("x"), F.col("l_extendedprice").alias("y"))
    return ST.spearman(rows, "x", "y").select("n", _r("rho"))


@query("""WITH c AS (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL), p AS (SELECT sum(n * (n - 1) / 2) AS ij, sum(n) AS n FROM c),
a AS (SELECT sum(n * (n - 1) / 2) AS ai FROM (SELECT sum(n) AS n FROM c GROUP BY quality)), b AS (SELECT sum(n * (n - 1) / 2) AS bj FROM (SELECT sum(n) AS n FROM c GROUP BY toxic))
SELECT n::BIGINT AS n, round((ij - ai * bj / (n * (n - 1) / 2)) / ((ai + bj) / 2 - ai * bj / (n * (n - 1) / 2)), 6) AS ari FROM p, a, b""")
def adjusted_rand(spark: SparkSession, d: str) -> DataFrame:
    return ST.adjusted_rand(T.read(spark, d, "labels"), "quality", "toxic").select("n", _r("ari"))


_XY = f"{_TYPICALITY}, {_VALUES}, xy AS (SELECT cluster, scene, typicality AS x, value AS y FROM t JOIN vals USING (scene))"


def _typicality_loss(spark: SparkSession, d: str) -> DataFrame:
    rows = V.typicality(_ready(spark, d), "cluster")
    return rows.join(A.mean_of_repeats(T.eval_window(spark, d), "scene", "value"), "scene").select("cluster", "scene", F.col("typicality").alias("x"), F.col("value").alias("y"))


@query(f"WITH {_XY}, g AS (SELECT count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, corr(x, y) AS pearson FROM xy) SELECT n, round(slope, 5) AS slope, round(intercept, 5) AS intercept, round(r2, 6) AS r2, round(pearson, 6) AS pearson, round(pearson * sqrt(greatest(n - 2, 0)) / sqrt(1 - r2), 5) AS t FROM g")
def ols_typicality(spark: SparkSession, d: str) -> DataFrame:
    return ST.regression(_typicality_loss(spark, d), "x", "y").select("n", _r("slope", 5), _r("intercept", 5), _r("r2"), _r("pearson"), _r("t", 5))


@query(f"WITH {_XY}, q AS (SELECT quantile_cont(y, 0.98) AS lim FROM xy) SELECT count(*) AS n, round(corr(x, ln(y)), 6) AS pearson FROM xy, q WHERE y <= lim AND y > 0")
def trimmed_log_correlation(spark: SparkSession, d: str) -> DataFrame:
    rows = ST.trim_top(_typicality_loss(spark, d), "y", 0.02).filter("y > 0").withColumn("ln", F.log("y"))
    return rows.agg(F.count("*").alias("n"), F.round(ST.correlation("x", "ln"), 6).alias("pearson"))


@query(f"WITH {_XY}, g AS (SELECT cluster, count(*)::DOUBLE AS w, avg(x) AS x, avg(y) AS y FROM xy GROUP BY cluster HAVING count(*) >= 3), s AS (SELECT sum(w) AS w, sum(w*x) AS x, sum(w*y) AS y, sum(w*x*x) AS xx, sum(w*y*y) AS yy, sum(w*x*y) AS xy FROM g) SELECT round((xy - x*y/w) / (xx - x*x/w), 4) AS slope, round(y/w - (xy - x*y/w) / (xx - x*x/w) * x/w, 4) AS intercept, round((xy - x*y/w) / sqrt((xx - x*x/w) * (yy - y*y/w)), 5) AS pearson FROM s")
def weighted_cluster_regression(spark: SparkSession, d: str) -> DataFrame:
    g = _typicality_loss(spark, d).groupBy("cluster").agg(F.count("*").cast("double").alias("w"), F.avg("x").alias("x"), F.avg("y").alias("y")).filter("w >= 3")
    return ST.weighted_regression(g, "x", "y", "w").select(_r("slope", 4), _r("intercept", 4), _r("pearson", 5))


@query(f"WITH {_XY}, b AS (SELECT *, ntile(10) OVER (ORDER BY round(x, 9), scene) AS bin FROM xy) SELECT bin::INTEGER AS bin, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM b GROUP BY bin")
def typicality_deciles(spark: SparkSession, d: str) -> DataFrame:
    rows = _typicality_loss(spark, d).withColumn("_x", F.round("x", 9))
    return W.quantile_bins(rows, "_x", 10, "scene").groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"))


@query(f"WITH {_TYPICALITY}, u AS (SELECT scene, round(typicality, 5) AS x, scene % 5 <> 0 AS train FROM t) SELECT a.scene, count(b.scene) AS density FROM u a LEFT JOIN u b ON b.train AND abs(b.x - a.x) <= 0.0300049 GROUP BY a.scene")
def local_density(spark: SparkSession, d: str) -> DataFrame:
    rows = V.typicality(_ready(spark, d), "cluster").select("scene", F.round("typicality", 5).alias("x"), (F.col("scene") % 5 != 0).alias("train"))
    return ST.local_density(rows, "x", "train", 0.0300049).select("scene", "density")


@query(f"WITH {_TYPICALITY}, s AS (SELECT cluster, count(*) AS n, median(typicality) AS mid, min(typicality) AS lo, max(typicality) AS hi FROM t GROUP BY cluster HAVING count(*) >= 10) SELECT cluster, n, round((hi - mid) / (hi - lo), 6) AS ring, round(avg((typicality >= hi - 0.1 * (hi - lo))::INTEGER), 6) AS top_share FROM t JOIN s USING (cluster) GROUP BY ALL")
def ring_ratio(spark: SparkSession, d: str) -> DataFrame:
    return ST.ring_ratio(V.typicality(_ready(spark, d), "cluster"), ["cluster"], "typicality").select("cluster", "n", _r("ring"), _r("top_share"))


# -------------------------------------------------------- geometry and metrics


_POSES = "poses AS (SELECT vec_id, vec_id // 10 AS win, embedding::DOUBLE[] AS v FROM embeddings)"


def _mat(q: list[str]) -> list[str]:
    """Row-order rotation of (x, y, z, w) in SQL."""
    x, y, z, w = q
    s = f"(2.0 / ({x}*{x} + {y}*{y} + {z}*{z} + {w}*{w}))"
    return [f"(1 - {s}*({y}*{y} + {z}*{z}))", f"({s}*({x}*{y} - {z}*{w}))", f"({s}*({x}*{z} + {y}*{w}))", f"({s}*({x}*{y} + {z}*{w}))", f"(1 - {s}*({x}*{x} + {z}*{z}))", f"({s}*({y}*{z} - {x}*{w}))", f"({s}*({x}*{z} - {y}*{w}))", f"({s}*({y}*{z} + {x}*{w}))", f"(1 - {s}*({x}*{x} + {y}*{y}))"]


_POSE_MATS = f"""{_POSES}, pm AS (SELECT vec_id, win, v[1:3] AS pt, list_transform(range(1, 4), lambda k: v[k] + 0.25 * v[k+7]) AS gt, v[4:7] AS pq, list_transform(range(4, 8), lambda k: v[k] + 0.25 * v[k+7]) AS gq FROM poses),
mats AS (SELECT vec_id, win, pt, gt, [{', '.join(_mat([f'pq[{k}]' for k in range(1, 5)]))}] AS pr, [{', '.join(_mat([f'gq[{k}]' for k in range(1, 5)]))}] AS gr FROM pm)"""


def _mul_t(a: str, b: str) -> str:
    """a times the transpose of b."""
    return "[" + ", ".join("(" + " + ".join(f"{a}[{3 * i + k + 1}]*{b}[{3 * j + k + 1}]" for k in range(3)) + ")" for i in range(3) for j in range(3)) + "]"


def _app(m: str, v: str) -> list[str]:
    return ["(" + " + ".join(f"{m}[{3 * i + k + 1}]*{v}[{k + 1}]" for k in range(3)) + ")" for i in range(3)]


_PAIR_ERRORS = f"""{_POSE_MATS}, rel AS (SELECT a.win, a.vec_id AS i, b.vec_id AS j, {_mul_t('b.pr', 'a.pr')} AS rp, {_mul_t('b.gr', 'a.gr')} AS rg, a.pt AS ap, b.pt AS bp, a.gt AS ag, b.gt AS bg FROM mats a JOIN mats b ON a.win = b.win AND a.vec_id < b.vec_id),
tr AS (SELECT win, i, j, rp, rg, [{', '.join(f'bp[{k + 1}] - {e}' for k, e in enumerate(_app('rp', 'ap')))}] AS tp, [{', '.join(f'bg[{k + 1}] - {e}' for k, e in enumerate(_app('rg', 'ag')))}] AS tg FROM rel),
err AS (SELECT win, i, j, degrees(acos(least(greatest((list_dot_product(rp, rg) - 1) / 2, -1), 1))) AS rot, degrees(acos(least(greatest(list_dot_product(tp, tg) / (sqrt(list_dot_product(tp, tp)) * sqrt(list_dot_product(tg, tg))), -1), 1))) AS trans FROM tr)"""


def _errors(spark: SparkSession, d: str) -> DataFrame:
    return M.pose_pair_errors(T.poses(spark, d), "window", "vec_id")


@query(f"WITH {_PAIR_ERRORS} SELECT win AS window, i, j, round(rot, 5) AS rot, round(trans, 5) AS trans FROM err".replace(" AS window", ' AS "window"'))
def pose_pair_errors(spark: SparkSession, d: str) -> DataFrame:
    return _errors(spark, d).select("window", "i", "j", _r("rot", 5), _r("trans", 5))


@query(f"""WITH {_PAIR_ERRORS}, e AS (SELECT win, greatest(rot, trans) AS worst, rot, trans FROM err) SELECT win AS "window", count(*) AS pairs, round(avg(rot), 5) AS rot_mean, round(quantile_disc(rot, 0.5), 5) AS rot_median, round(avg(trans), 5) AS trans_mean, round(quantile_disc(trans, 0.5), 5) AS trans_median,
 round(avg((rot < 5)::INTEGER), 6) AS rra_at_5, round(avg((trans < 5)::INTEGER), 6) AS rta_at_5, round(avg(list_sum(list_transform(range(1, 31), lambda k: (worst < k)::INTEGER))) / 30, 6) AS auc_at_30 FROM e GROUP BY win""")
def pose_metrics(spark: SparkSession, d: str) -> DataFrame:
    got = M.pose_summary(_errors(spark, d), ["window"])
    return got.select("window", "pairs", *[_r(c, 5) for c in ("rot_mean", "rot_median", "trans_mean", "trans_median")], *[_r(c) for c in ("rra_at_5", "rta_at_5", "auc_at_30")])


@query(f"WITH {_POSES}, q AS (SELECT vec_id, v[1:4] AS q FROM poses), n AS (SELECT vec_id, list_transform(q, lambda x: x / sqrt(list_dot_product(q, q))) AS q FROM q) SELECT vec_id, " + ", ".join(f"round(q[{k}] * CASE WHEN q[4] < 0 THEN -1 ELSE 1 END, 6) + 0.0 AS {c}" for k, c in enumerate(("x", "y", "z", "w"), 1)) + ", true AS same FROM n")
def pose_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Quaternion to matrix and back; a pose and its intrinsics encoded and decoded."""
    e = T.read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    m = R.quat_to_matrix(*[F.col("v")[k] for k in range(4)])
    e = e.select("vec_id", "v", *[c.alias(f"m{k}") for k, c in enumerate(m)])
    m = [F.col(f"m{k}") for k in range(9)]
    t = [F.col("v")[k] for k in (4, 5, 6)]
    enc = R.encode_pose(m, t, F.lit(500.0), F.lit(400.0), F.lit(480.0), F.lit(640.0))
    e = e.select("vec_id", *[c.alias(f"m{k}") for k, c in enumerate(m)], *[c.alias(f"e{k}") for k, c in enumerate(enc)])
    dec = R.decode_pose([F.col(f"e{k}") for k in range(9)], F.lit(480.0), F.lit(640.0))
    same = (F.abs(dec["fx"] - 500) < 1e-6) & (F.abs(dec["fy"] - 400) < 1e-6)
    for k in range(9):
        same = same & (F.abs(dec[f"r{k}"] - F.col(f"m{k}")) < 1e-6)
    return e.select("vec_id", *[(F.round(f"e{k}", 6) + 0.0).alias(c) for k, c in zip((3, 4, 5, 6), "xyzw", strict=True)], same.alias("same"))


@query(f"WITH {_OBS}, m AS (SELECT supp, quantile_disc(z, 0.5) / quantile_disc(z * (1 - discount) * (1 + tax), 0.5) AS s FROM obs WHERE z > 1e-6 GROUP BY supp), p AS (SELECT supp, s, z AS g, z * (1 - discount) * (1 + tax) AS p FROM obs JOIN m USING (supp) WHERE z > 1e-6) SELECT supp, round(s, 6) AS scale_ratio, round(avg(abs(p - g) / g), 9) AS abs_rel, round(avg((greatest(p / g, g / p) < 1.25)::INTEGER), 6) AS delta FROM p GROUP BY ALL")
def depth_metrics(spark: SparkSession, d: str) -> DataFrame:
    px = T.observations(spark, d).withColumn("pred", F.col("z") * (1 - F.col("discount")) * (1 + F.col("tax")))
    return M.depth_metrics(px, ["supp"], "pred", "z").select("supp", _r("scale_ratio"), _r("abs_rel", 9), _r("delta"))


@query(f"WITH {_OBS}, m AS (SELECT supp, quantile_disc(z, 0.5) / quantile_disc(z * (1 - discount) * (1 + tax), 0.5) AS s FROM obs WHERE z > 1e-6 GROUP BY supp), p AS (SELECT supp, s, z AS g, s * z * (1 - discount) * (1 + tax) AS p FROM obs JOIN m USING (supp) WHERE z > 1e-6) SELECT supp, round(avg(abs(p - g) / g), 9) AS abs_rel FROM p GROUP BY supp")
def depth_metrics_aligned(spark: SparkSession, d: str) -> DataFrame:
    px = T.observations(spark, d).withColumn("pred", F.col("z") * (1 - F.col("discount")) * (1 + F.col("tax")))
    return M.depth_metrics(px, ["supp"], "pred", "z", align_median=True).select("supp", _r("abs_rel", 9))


@query(f"WITH {_OBS} SELECT supp, error, z, frame, line FROM obs QUALIFY row_number() OVER (PARTITION BY supp, error ORDER BY z, frame, line, point) = 1")
def zbuffer(spark: SparkSession, d: str) -> DataFrame:
    return W.nearest_surface(T.observations(spark, d), ["supp", "error"], "z", F.asc("frame"), F.asc("line"), F.asc("point")).select("supp", "error", "z", "frame", "line")


_GRID = "grid AS (SELECT p_size AS y, CAST(substr(p_brand, 7) AS INTEGER) AS x, avg(p_retailprice) AS z FROM part GROUP BY ALL)"


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return T.read(spark, d, "part").groupBy(F.col("p_size").alias("y"), F.substring("p_brand", 7, 9).cast("int").alias("x")).agg(F.avg("p_retailprice").alias("z"))


@query(f"""WITH {_GRID}, a AS (SELECT *, min(z) OVER (PARTITION BY y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS lo, max(z) OVER (PARTITION BY y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS hi FROM grid),
b AS (SELECT y, x, z, min(lo) OVER (PARTITION BY x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS low, max(hi) OVER (PARTITION BY x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS high FROM a)
SELECT y, x, round(low, 6) AS low, round(high, 6) AS high, (high - low) / z > 0.25 AS edge FROM b""")
def depth_edges(spark: SparkSession, d: str) -> DataFrame:
    return W.depth_edges(_grid(spark, d), [], "y", "x", "z", 0.25).select("y", "x", _r("low"), _r("high"), "edge")


@query(f"WITH {_GRID}, n AS (SELECT y, x, z, z > 940 AS valid, lead(z) OVER w AS nz, lead(z) OVER w > 940 AS nv, lead(x) OVER w AS nx FROM grid WINDOW w AS (PARTITION BY y ORDER BY x)) SELECT y, count(*) AS pairs, round(avg(abs(nz - z)), 6) AS grad FROM n WHERE valid AND nv AND nx = x + 1 GROUP BY y")
def grad_pairs(spark: SparkSession, d: str) -> DataFrame:
    grid = _grid(spark, d).withColumn("valid", F.col("z") > 940)
    return W.forward_pairs(grid, ["y"], "x", "z", "valid").groupBy("y").agg(F.count("*").alias("pairs"), F.round(F.avg(F.abs("diff")), 6).alias("grad"))


@query(f"""WITH {_OBS}, lim AS (SELECT greatest(quantile_cont(z, 0.001), 1e-3) AS lo, quantile_cont(z, 0.9999) AS h FROM obs), l AS (SELECT lo, greatest(h, lo * 1.001) AS hi FROM lim),
q AS (SELECT frame, line, point, z, lo, hi, round_even(round(65535 * (ln(least(greatest(z, lo), hi)) - ln(lo)) / (ln(hi) - ln(lo)), 6), 0)::INTEGER AS q FROM obs, l)
SELECT frame, line, point, q, round(CASE WHEN q > 0 AND q < 65535 THEN exp(ln(lo) + q / 65535.0 * (ln(hi) - ln(lo))) END, 4) AS depth FROM q""")
def quantise_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    obs = T.observations(spark, d)
    rows = obs.crossJoin(F.broadcast(A.log_range(obs, "z")))  # one row
    share = (F.log(F.least(F.greatest("z", "lo"), "hi")) - F.log("lo")) / (F.log("hi") - F.log("lo"))
    coded = rows.withColumn("q", F.bround(F.round(65535 * share, 6)).cast("int"))
    return coded.select("frame", "line", "point", "q", F.round(S.dequantise_log(F.col("q"), F.col("lo"), F.col("hi")), 4).alias("depth"))


@query(f"WITH {_OBS}, lim AS (SELECT supp, greatest(quantile_cont(z, 0.001), 1e-3) AS lo, quantile_cont(z, 0.9999) AS h FROM obs GROUP BY supp), l AS (SELECT supp, lo, greatest(h, lo * 1.001) AS hi FROM lim) SELECT supp, round(lo, 7) AS lo, round(hi, 7) AS hi, round(avg((z < lo OR z > hi)::INTEGER), 6) AS clipped FROM obs JOIN l USING (supp) GROUP BY ALL")
def clip_range(spark: SparkSession, d: str) -> DataFrame:
    return A.clip_range(T.observations(spark, d), ["supp"], "z").select("supp", _r("lo", 7), _r("hi", 7), _r("clipped"))


@query(f"WITH {_OBS} SELECT supp, round(quantile_cont(z, 0.05), 4) AS p05, round(quantile_cont(z, 0.5), 4) AS p50, round(quantile_cont(z, 0.95), 4) AS p95 FROM obs GROUP BY supp")
def depth_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return A.depth_percentiles(T.observations(spark, d), ["supp"], "z").select("supp", _r("p05", 4), _r("p50", 4), _r("p95", 4))


@query(f"WITH {_OBS}, f AS (SELECT point, supp, median(z) AS m FROM obs GROUP BY ALL) SELECT supp, round(median(m), 4) AS median FROM f GROUP BY supp")
def median_of_medians(spark: SparkSession, d: str) -> DataFrame:
    frames = A.depth_percentiles(T.observations(spark, d), ["point", "supp"], "z")
    return A.median_of_medians(frames, ["supp"]).select("supp", _r("median", 4))


@query(f"""WITH {_OBS}, p AS (SELECT supp, frame, line, point, z, error AS y, discount AS x, sqrt(z * z + error * error + discount * discount) AS d FROM obs), lim AS (SELECT supp, 100 * median(d) AS lim FROM p WHERE d > 0 GROUP BY supp),
c AS (SELECT p.* FROM p JOIN lim USING (supp) WHERE d > 0 AND d <= lim), s AS (SELECT supp, avg(d) AS scale FROM c GROUP BY supp) SELECT supp, count(*) AS n, round(any_value(scale), 4) AS scale, round(avg(sqrt((z / scale) ** 2 + (y / scale) ** 2 + (x / scale) ** 2)), 6) AS mean_distance FROM c JOIN s USING (supp) GROUP BY supp""")
def scene_normalisation(spark: SparkSession, d: str) -> DataFrame:
    """After normalisation the mean distance of a scene's points is 1."""
    pts = T.observations(spark, d).select("supp", F.col("z"), F.col("error").alias("y"), F.col("discount").alias("x"))
    got = G.normalise_scene(pts, ["supp"], ("z", "y", "x"))
    distance = F.sqrt(F.col("z") ** 2 + F.col("y") ** 2 + F.col("x") ** 2)
    return got.groupBy("supp").agg(F.count("*").alias("n"), F.round(F.first("scale"), 4).alias("scale"), F.round(F.avg(distance), 6).alias("mean_distance"))


@query(f"""WITH {_OBS}, e AS (SELECT point, quantile_cont(z, 0.95) - quantile_cont(z, 0.05) AS a, quantile_cont(error, 0.95) - quantile_cont(error, 0.05) AS b, quantile_cont(tax, 0.95) - quantile_cont(tax, 0.05) AS c FROM obs GROUP BY point) SELECT point, round(CASE WHEN a*a + b*b + c*c > 0 THEN sqrt(a*a + b*b + c*c) ELSE 1 END, 4) AS extent FROM e""")
def scene_extent(spark: SparkSession, d: str) -> DataFrame:
    return A.scene_extent(T.observations(spark, d), ["point"], ("z", "error", "tax")).select("point", _r("extent", 4))


@query(f"""WITH {_OBS}, q AS (SELECT quantile_cont(error, 0.75) AS lim FROM obs) SELECT frame, line, point, error FROM obs, q WHERE error >= lim AND error > 1e-5""")
def confidence_points(spark: SparkSession, d: str) -> DataFrame:
    return P.confidence_percentile(T.observations(spark, d), "error", 75).select("frame", "line", "point", "error")


@query("WITH n AS (SELECT count(*) AS n FROM orders), t AS (SELECT DISTINCT floor(i * ((n - 1) / 999.0))::BIGINT AS k FROM n, range(1000) r(i)), o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS k FROM orders) SELECT o_orderkey FROM o JOIN t USING (k)")
def evenly_spaced_sample(spark: SparkSession, d: str) -> DataFrame:
    return W.evenly_spaced(T.read(spark, d, "orders"), [F.asc("o_orderdate"), F.asc("o_orderkey")], 1000).select("o_orderkey")


@query("WITH l AS (SELECT event_id + 1 AS step, value FROM events) SELECT ((step - 1) // 50)::BIGINT AS \"window\", min(step) AS first_step, max(step) AS last_step, count(*) AS n, round(avg(value), 6) AS value FROM l GROUP BY 1")
def log_window_means(spark: SparkSession, d: str) -> DataFrame:
    log = T.read(spark, d, "events").select((F.col("event_id") + 1).alias("step"), "value")
    return W.count_windows(log, "step", 50, ["value"]).select("window", "first_step", "last_step", "n", _r("value"))


@query("""WITH p AS (SELECT p_partkey, p_size * 40 AS h, (substr(p_brand, 7)::INTEGER) * 30 AS w FROM part), r AS (SELECT p_partkey, h, w, w / h AS a FROM p)
SELECT p_partkey, greatest(14, (round_even(round(518 / sqrt(a) / 14, 9), 0) * 14)::INTEGER) AS bh, greatest(14, (round_even(round(518 * sqrt(a) / 14, 9), 0) * 14)::INTEGER) AS bw, least(w, floor(h * 2.0))::INTEGER AS cw, least(h, floor(w / 0.5))::INTEGER AS ch FROM r""")
def target_shapes(spark: SparkSession, d: str) -> DataFrame:
    p = T.read(spark, d, "part").select("p_partkey", (F.col("p_size") * 40).alias("h"), (F.substring("p_brand", 7, 9).cast("int") * 30).alias("w"))
    aspect = F.col("w") / F.col("h")
    rounded = lambda x: F.greatest(F.lit(14), (F.bround(F.round(x / 14, 9)) * 14).cast("int"))
    crop = S.aspect_crop(F.col("h"), F.col("w"))
    return p.select("p_partkey", rounded(518 / F.sqrt(aspect)).alias("bh"), rounded(518 * F.sqrt(aspect)).alias("bw"), crop["width"].alias("cw"), crop["height"].alias("ch"))


@query("SELECT event_id, round(CASE WHEN event_id < 100 THEN (event_id + 1) / 100.0 ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * least(greatest((event_id - 100) / 900.0, 0), 1))) END, 9) AS rate FROM events")
def learning_rate(spark: SparkSession, d: str) -> DataFrame:
    return T.read(spark, d, "events").select("event_id", F.round(S.learning_rate(F.col("event_id"), 100, 1000, 0.1), 9).alias("rate"))


# ------------------------------------------------------------- draws by digests


def _unit_sql(*keys: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(keys)})), 1, 12))::BIGINT / 281474976710656.0)"


@query(f"WITH {_SCENES} SELECT subset, scene, CASE WHEN {_unit_sql('subset', 'scene', '0')} < 0.1 THEN 'val' ELSE 'train' END AS split FROM scenes")
def train_val_split(spark: SparkSession, d: str) -> DataFrame:
    return SA.train_val_split(T.scenes(spark, d), ["subset", "scene"], 0.1, seed=0).select("subset", "scene", "split")


@query(f"WITH {_FEATURE}, r AS (SELECT scene, img_no, row_number() OVER (PARTITION BY scene ORDER BY md5(concat_ws('|', scene, img_no, 0)), img_no) - 1 AS k, count(*) OVER (PARTITION BY scene) AS c FROM feature) SELECT scene, s::INTEGER AS slot, img_no::INTEGER AS img_no FROM r, range(3) t(s) WHERE k < 3 AND s % least(c, 3) = k")
def images_per_scene(spark: SparkSession, d: str) -> DataFrame:
    return SA.images_per_scene(T.feature(spark, d), ["scene"], "img_no", 3).select("scene", "slot", "img_no")


@query(f"WITH {_OBS}, r AS (SELECT supp, frame, row_number() OVER (PARTITION BY supp ORDER BY frame, line) - 1 AS k, count(*) OVER (PARTITION BY supp) AS c FROM obs) SELECT supp, frame FROM r WHERE c >= 8 AND k >= floor({_unit_sql('supp', '0')} * (c - 7)) AND k < floor({_unit_sql('supp', '0')} * (c - 7)) + 8")
def contiguous_window(spark: SparkSession, d: str) -> DataFrame:
    return SA.contiguous_window(T.observations(spark, d), ["supp"], "frame", 8).select("supp", "frame")


@query(f"WITH {_OBS}, f AS (SELECT DISTINCT supp, frame FROM obs) SELECT supp, frame FROM f QUALIFY row_number() OVER (PARTITION BY supp ORDER BY md5(concat_ws('|', supp, frame, 0)), frame) <= 5")
def random_frames(spark: SparkSession, d: str) -> DataFrame:
    return SA.random_frames(T.observations(spark, d).select("supp", "frame").distinct(), ["supp"], "frame", 5)


@query(f"WITH {_FEATURE} SELECT scene, img_no::INTEGER AS img_no, (CASE WHEN {_unit_sql('scene', '3')} < 0.5 THEN max(img_no) OVER (PARTITION BY scene) - img_no ELSE img_no END)::INTEGER AS position FROM feature")
def flip_half(spark: SparkSession, d: str) -> DataFrame:
    rows = T.feature(spark, d).select("scene", "img_no", F.col("img_no").alias("position"))
    return SA.flip_half(rows, ["scene"], "position", seed=3)


# --------------------------------------------------- iterations: checked by rows


@query()
def covisibility_walk(spark: SparkSession, d: str) -> DataFrame:
    """Frames of a customer's orders, walked by shared parts."""
    obs = T.observations(spark, d).join(T.read(spark, d, "orders").select(F.col("o_orderkey").alias("frame"), (F.col("o_custkey") % 97).alias("scene")), "frame")
    return SA.covisibility_walk(obs.select("scene", "frame"), J.covisibility(obs, "frame", "point", scene=["scene"]), "scene", 6)


@query()
def spherical_kmeans(spark: SparkSession, d: str) -> DataFrame:
    return C.spherical_kmeans(_ready(spark, d), 10).select("scene", "cluster", _r("cosine"))


@query()
def communities(spark: SparkSession, d: str) -> DataFrame:
    return C.communities(_ready(spark, d))


from . import parts  # noqa: E402, F401  registers more queries

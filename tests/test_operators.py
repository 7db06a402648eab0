"""Hand fixtures for the corners of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import rotation as R
from lumenfold.functions import scalar as S
from lumenfold.functions import vector as V
from lumenfold.operators import aggregates as A
from lumenfold.operators import clustering as C
from lumenfold.operators import filters as P
from lumenfold.operators import geometry as G
from lumenfold.operators import joins as J
from lumenfold.operators import metrics as M
from lumenfold.operators import sampling as SA
from lumenfold.operators import stats as ST
from lumenfold.operators import vectors as VE
from lumenfold.operators import windows as W


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_nan_null_and_absent_metrics(spark):
    nan = float("nan")
    w = spark.createDataFrame([("a", 1.0), ("a", nan), ("b", None), ("b", 3.0), ("c", nan)], "scene string, loss double")
    assert rows(A.mean_of_repeats(w, "scene", "loss")) == [("a", 1.0, 1), ("b", 3.0, 1)]
    strict = {r["scene"]: r["value"] for r in A.mean_of_repeats(w, "scene", "loss", strict=True).collect()}
    assert math.isnan(strict["a"]) and strict["b"] == 3.0 and math.isnan(strict["c"])
    assert rows(A.biased_means(w, ["loss"])) == [(4.0 / 5,)]


def test_cluster_sizes_zero_one_two(spark):
    members = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (2, "d")], "cluster int, scene string")
    values = spark.createDataFrame([("b", 2.0), ("c", 1.0), ("d", 4.0)], "scene string, value double")
    got = {r["cluster"]: r for r in A.cluster_report(members, values).collect()}
    assert (got[0]["n"], got[0]["mean"], got[0]["std"], got[0]["missing"]) == (0, None, None, 1)
    assert (got[1]["n"], got[1]["std"]) == (1, 0.0)
    assert got[2]["median"] == 2.5 and got[2]["std"] == pytest.approx(2.1213, abs=1e-4)


def test_two_medians(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10)], "x double")
    assert df.select(F.median("x"), S.lower_median("x")).first()[:] == (2.5, 2.0)


def test_shape_ties(spark):
    df = spark.createDataFrame([(0, 9, 9), (1, 1, 1), (2, 9, 9), (3, 1, 1)], "i int, h int, w int")
    assert rows(P.modal_shape(df, ["h", "w"]).select("i")) == [(1,), (3,)]
    assert rows(P.modal_shape(df, ["h", "w"], order="i").select("i")) == [(0,), (2,)]
    with pytest.raises(ValueError):
        P.modal_shape(df, ["h", "w"], explicit=(5, 5))


def test_percent_prefix_rounds_half_even(spark):
    members = spark.createDataFrame([(c, k) for c, n in ((1, 2), (2, 5), (3, 15), (4, 25)) for k in range(n)], "cluster int, k int")
    got = C.select_subset(members, "cluster", "k", percent=10.0).groupBy("cluster").count()
    assert rows(got) == [(1, 1), (2, 1), (3, 2), (4, 2)]  # 0.2 and 0.5 give at least one, 1.5 and 2.5 go to even


def test_exact_score_tie(spark):
    df = spark.createDataFrame([("s", 2, 1.0), ("s", 1, 1.0), ("s", 3, 0.5)], "scene string, option int, score double")
    assert rows(W.best_and_runner_up(df, ["scene"], "option", "score")) == [("s", 1, 1.0, 2, 1.0, 0.0)]


def test_overlap_is_over_the_smaller_set(spark):
    obs = spark.createDataFrame([(1, p) for p in (1, 2, 3)] + [(2, p) for p in (1, 2)], "frame int, point int")
    assert rows(J.covisibility(obs, "frame", "point")) == [(1, 2, 2, 1.0)]


def test_fallback_of_points_and_matches(spark):
    pts = spark.createDataFrame([("a", 1.0, 3), ("a", 9.0, 2), ("b", 1.0, 3), ("b", 1.0, 4)], "scene string, error double, track int")
    assert rows(P.point_quality(pts, "scene", "error", "track", 2.0, 3, 2)) == [("a", 1.0, 3), ("a", 9.0, 2), ("b", 1.0, 3), ("b", 1.0, 4)]
    left = spark.createDataFrame([(1, "x.jpeg"), (2, "y.jpeg"), (3, "z.jpeg")], "k int, name string")
    files = spark.createDataFrame([(1, "x.jpeg", "p1"), (2, "y.png", "p2")], "k int, file string, path string")
    got = J.match_fallback(left, files, "k", [F.col("name"), F.concat(S.stem(F.col("name")), F.lit(".png"))], F.col("file"), "path")
    assert rows(got.select("k", "match_value", "match_place")) == [(1, "p1", 0), (2, "p2", 1)]


def test_quaternion_round_trip_and_sign(spark):
    s = math.sqrt(0.5)
    qs = [(0.0, 0.0, 0.0, 1.0), (1.0, 0.0, 0.0, 0.0), (0.0, 1.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0), (s, 0.0, 0.0, s), (-0.5, 0.5, -0.5, -0.5)]
    df = spark.createDataFrame(qs, "x double, y double, z double, w double")
    back = R.matrix_to_quat(R.quat_to_matrix(*[F.col(c) for c in "xyzw"]))
    minus = R.quat_to_matrix(*[-F.col(c) for c in "xyzw"])
    plus = R.quat_to_matrix(*[F.col(c) for c in "xyzw"])
    for r in df.select("x", "y", "z", "w", *[c.alias(f"b{k}") for k, c in enumerate(back)], R.rotation_degrees(plus, minus).alias("angle")).collect():
        sign = -1 if r["w"] < 0 else 1
        assert [r[f"b{k}"] for k in range(4)] == pytest.approx([sign * r[k] for k in range(4)], abs=1e-9)
        assert r["angle"] == pytest.approx(0, abs=1e-5)


def test_project_and_unproject(spark):
    df = spark.createDataFrame([(0.3, -0.2, 4.0), (1.0, 1.0, 2.0)], "x double, y double, z double")
    r, t = R.quat_to_matrix(*[F.lit(v) for v in (0.1, 0.2, -0.1, 0.9)]), [F.lit(v) for v in (0.1, 0.2, 0.3)]
    k = [F.lit(v) for v in (500.0, 400.0, 320.0, 240.0)]
    u, v, z = R.project(r, t, *k, [F.col(c) for c in "xyz"])
    back = R.unproject(u, v, z, r, t, *k)
    for row in df.select("x", "y", "z", *[c.alias(f"b{i}") for i, c in enumerate(back)]).collect():
        assert list(row[3:]) == pytest.approx(list(row[:3]))


def test_rebase_makes_the_first_camera_the_identity(spark):
    r, t = R.quat_to_matrix(*[F.lit(v) for v in (0.1, 0.2, -0.1, 0.9)]), [F.lit(v) for v in (0.1, 0.2, 0.3)]
    r1, t1 = R.rebase(r, t, r, t)
    got = spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate([*r1, *t1])]).first()
    assert list(got) == pytest.approx([1, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0], abs=1e-12)


def test_pinhole_models(spark):
    df = spark.createDataFrame([("SIMPLE_RADIAL", [1.0, 2.0, 3.0, 4.0]), ("FULL_OPENCV", [float(k) for k in range(12)])], "model string, params array<double>")
    got = {r["model"]: r["p"] for r in df.select("model", R.to_pinhole(F.col("model"), F.col("params")).alias("p")).collect()}
    assert tuple(got["SIMPLE_RADIAL"][:4]) == (1.0, 1.0, 2.0, 3.0) and got["SIMPLE_RADIAL"]["dist"] == [4.0, 0, 0, 0, 0]
    assert got["FULL_OPENCV"]["dist"] == [4.0, 5.0, 6.0, 7.0, 8.0]
    with pytest.raises(Exception, match="no pinhole form"):
        spark.createDataFrame([("FOV", [1.0])], "model string, params array<double>").select(R.to_pinhole(F.col("model"), F.col("params"))).collect()


def test_coincident_centres_score_ninety(spark):
    zero = [F.lit(0.0)] * 3
    assert spark.range(1).select(R.direction_degrees(zero, [F.lit(1.0), F.lit(0.0), F.lit(0.0)])).first()[0] == pytest.approx(90)


def test_pose_auc_edges(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0, v, 0.0) for v in (0.0, 0.5, 1.0, 29.5, 30.0, nan)], "window int, rot double, trans double")
    # 0 and 0.5 earn 30 thresholds, 1.0 earns 29 (strict), 29.5 one, 30 and NaN none
    assert M.pose_auc(df, ["window"]).first()["auc_at_30"] == pytest.approx((30 + 30 + 29 + 1) / 180)


def test_depth_metrics_scale_and_empty(spark):
    df = spark.createDataFrame([("a", 2.0, 1.0), ("a", 4.0, 2.0), ("b", 1.0, 0.0)], "s string, p double, g double")
    plain = {r["s"]: r for r in M.depth_metrics(df, ["s"], "p", "g").collect()}
    assert plain["a"]["abs_rel"] == 1.0 and plain["a"]["scale_ratio"] == 0.5 and math.isnan(plain["b"]["abs_rel"])
    assert {r["s"]: r["abs_rel"] for r in M.depth_metrics(df, ["s"], "p", "g", align_median=True).collect()}["a"] == 0.0


def test_constant_plane_normalises_to_one(spark):
    pts = spark.createDataFrame([(1, 3.0, 4.0, 0.0)] * 9 + [(1, 1e17, 0.0, 0.0)], "s int, x double, y double, z double")
    got = G.normalise_scene(pts, ["s"], ("x", "y", "z"))
    assert got.count() == 9 and got.first()["x"] == pytest.approx(0.6) and got.first()["usable"]


def test_quantise_ends_and_error(spark):
    df = spark.createDataFrame([(0.001,), (0.5,), (2.0,), (7.3,), (1000.0,)], "x double")
    q = S.quantise_log(F.col("x"), F.lit(0.01), F.lit(100.0))
    got = [(r["x"], r["q"], r["d"]) for r in df.select("x", q.alias("q"), S.dequantise_log(q, F.lit(0.01), F.lit(100.0)).alias("d")).orderBy("x").collect()]
    assert got[0][1:] == (0, None) and got[-1][1:] == (65535, None)
    assert all(abs(d / x - 1) < 1e-4 for x, _, d in got[1:-1])


def test_nearest_surface_and_neighbourhood(spark):
    px = spark.createDataFrame([(0, 0, 2.0), (0, 0, 1.0), (0, 1, 5.0)], "y int, x int, z double")
    assert rows(W.nearest_surface(px, ["y", "x"], "z")) == [(0, 0, 1.0), (0, 1, 5.0)]
    grid = spark.createDataFrame([(y, x, float(10 * y + x)) for y in range(3) for x in range(3)], "y int, x int, z double")
    got = {(r["y"], r["x"]): (r["low"], r["high"]) for r in W.neighbourhood_range(grid, [], "y", "x", "z").collect()}
    assert got[1, 1] == (0.0, 22.0) and got[0, 0] == (0.0, 11.0)


def test_ranks_and_correlations(spark):
    df = spark.createDataFrame([(1.0, 3.0), (1.0, 2.0), (2.0, 1.0)], "a double, b double")
    assert sorted(r["r"] for r in W.average_rank(df, "a", "r").collect()) == [1.5, 1.5, 3.0]
    assert math.isnan(ST.spearman(df.limit(2), "a", "b").first()["rho"])
    assert math.isnan(ST.spearman(df.withColumn("a", F.lit(1.0)), "a", "b").first()["rho"])


def test_adjusted_rand(spark):
    df = spark.createDataFrame([(k // 4, 9 - k // 4) for k in range(8)], "a int, b int")
    assert ST.adjusted_rand(df, "a", "b").first()["ari"] == pytest.approx(1.0)
    assert math.isnan(ST.adjusted_rand(df.withColumns({"a": F.lit(0), "b": F.lit(0)}), "a", "b").first()["ari"])


def test_padding_of_short_scenes(spark):
    imgs = spark.createDataFrame([("a", 0), ("a", 1), ("b", 5)], "scene string, img int")
    got = SA.images_per_scene(imgs, ["scene"], "img", 4)
    assert rows(got.groupBy("scene").agg(F.count("*"), F.countDistinct("img"), F.countDistinct("slot"))) == [("a", 4, 2, 4), ("b", 4, 1, 4)]


def test_evenly_spaced_and_global_rank(spark):
    df = spark.range(1000).select(F.col("id").alias("x"))
    got = [r["x"] for r in W.evenly_spaced(df, [F.asc("x")], 7).orderBy("x").collect()]
    assert got == [int(i * (999 / 6.0)) for i in range(7)]
    assert W.evenly_spaced(df, [F.asc("x")], 5000).count() == 1000


def test_singleton_cluster_and_closed_forms(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    data = [(k % 3 if k < 12 else 9, k, rng.standard_normal(8).tolist()) for k in range(13)]
    df = spark.createDataFrame(data, "cluster int, scene long, centroid array<double>")
    x, c = np.array([d[2] for d in data]), np.array([d[0] for d in data])
    co = {r["cluster"]: r["cohesion"] for r in VE.cohesion(df, "cluster").collect()}
    ty = {r["scene"]: r["typicality"] for r in VE.typicality(df, "cluster").collect()}
    assert co[9] is None and ty[12] == 0.0
    for k in range(3):
        own = np.flatnonzero(c == k)
        s = x[own] @ x[own].T
        assert co[k] == pytest.approx((s.sum() - np.trace(s)) / (len(own) * (len(own) - 1)))
        for i, j in enumerate(own):
            assert ty[j] == pytest.approx((s[i].sum() - s[i, i]) / (len(own) - 1))


def test_kmeans_and_communities_find_planted_groups(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    base = np.eye(3, 8) * 4
    data = [(k, (base[k % 3] + 0.1 * rng.standard_normal(8)).tolist()) for k in range(60)]
    df = spark.createDataFrame(data, "scene long, centroid array<double>")
    km = C.spherical_kmeans(df, 3, n_init=3)
    again = C.spherical_kmeans(df.repartition(3), 3, n_init=3)
    assert rows(km.select("scene", "cluster")) == rows(again.select("scene", "cluster"))
    truth = df.select("scene", (F.col("scene") % 3).alias("t"))
    assert ST.adjusted_rand(km.join(truth, "scene"), "cluster", "t").first()["ari"] == pytest.approx(1.0)
    unit = df.withColumn("centroid", V.unit(F.col("centroid")))
    assert ST.adjusted_rand(C.communities(unit, gamma=1.0, start=6).join(truth, "scene"), "cluster", "t").first()["ari"] == pytest.approx(1.0)
    assert C.spherical_kmeans(df.limit(0), 3).count() == 0


def test_upsert_touches_attempted_keys_only(spark):
    index = spark.createDataFrame([(1, "a", True), (2, "b", None)], "k int, name string, has_depth boolean")
    tried = spark.createDataFrame([(2, False)], "k int, has_depth boolean")
    assert rows(J.upsert(index, tried, ["k"], ["has_depth"])) == [(1, "a", True), (2, "b", False)]


def test_gates_splits_and_guards(spark):
    s = spark.createDataFrame([("a", None, None), ("b", 30, True)], "scene string, num_frames int, has_depth boolean")
    assert P.dense_only(s, None).count() == 2 and P.dense_only(s, "root").count() == 1
    assert P.min_frames(s, 1).count() == 1
    with pytest.raises(ValueError):
        P.require_present(s.select("scene"), s.filter("scene = 'a'").select("scene"), ["scene"])
    with pytest.raises(ValueError):
        P.by_split(s.withColumn("split", F.lit("val")), "train", require=True)


def test_losses(spark):
    px = spark.createDataFrame([(1, 2.0, 1.0, 1.0, True), (1, 5.0, 1.0, 1.0, False), (2, 1.0, 1.0, 1.0, False)], "s int, p double, g double, c double, m boolean")
    got = {r["s"]: r for r in M.uncertainty_loss(px, ["s"], "p", "g", "c", F.col("m")).collect()}
    assert got[1]["err"] == 1.0 and got[1]["valid"] == 0.5 and got[2]["conf_loss"] == 0.0
    poses = spark.createDataFrame([(1, *[0.0] * 3, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, *[0.0] * 3, 0.0, 0.0, 0.0, -1.0, 1.0, 1.0)], "s int, " + ", ".join(f"{p}{c} double" for p in ("p_", "g_") for c in M.POSE))
    assert M.camera_loss(poses, ["s"]).first()["loss_camera"] == 0.0  # a negated quaternion is the same rotation
    assert M.total_loss(spark.range(1).select(F.lit(2.0).alias("a")), {"a": 5.0, "b": 1.0}).first()["loss"] == 10.0


def test_masked_mean_and_colours(spark):
    df = spark.createDataFrame([(1.0, False)], "x double, m boolean")
    assert df.agg(S.masked_mean(F.col("x"), F.col("m"))).first()[0] == 0.0
    t = spark.createDataFrame([(-1.0,), (0.0,), (0.5,), (1.0,), (9.0,)], "t double")
    assert [r[0] for r in t.select(S.colour(F.col("t"))).collect()] == ["#0d366b", "#0d366b", "#3987e5", "#cde2fb", "#cde2fb"]

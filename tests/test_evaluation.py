"""Walks over all frames, p-values, lower quantiles, step terms, sinks with markers."""

import math

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import aggregates, metrics, sampling, stats, windows
from lumenfold.sources import documents


def test_walk_takes_frames_without_overlap(spark):
    frames = spark.createDataFrame([("a", i) for i in range(6)] + [("b", 9), ("a", None)], "scene string, frame long")
    pairs = spark.createDataFrame([("a", 0, 1, 0.9), ("c", 1, 2, 0.5)], "scene string, fi long, fj long, overlap double")
    got = sampling.covisibility_walk(frames, pairs, "scene", 6).collect()
    assert sorted(r.frame for r in got if r.scene == "a") == list(range(6))
    assert [(r.frame, r.pos) for r in got if r.scene == "b"] == [(9, 0)] and len(got) == 7
    assert sampling.covisibility_walk(frames.limit(0), pairs.limit(0), "scene", 6).count() == 0


@pytest.mark.parametrize("t", [0.0, 0.3, -1.7, 4.0, 12.0])
def test_p_value_has_its_closed_forms(spark, t):
    rows = spark.createDataFrame([(t, 1), (t, 2), (t, 10**8), (t, 0)], "t double, df long")
    got = [r.p for r in rows.select("df", stats.p_value(F.col("t"), F.col("df")).alias("p")).collect()]
    want = [1 - 2 / math.pi * math.atan(abs(t)), 1 - abs(t) / math.sqrt(2 + t * t), math.erfc(abs(t) / math.sqrt(2))]
    assert got[3] is None
    assert all(abs(g - w) < 1e-7 for g, w in zip(got, want, strict=False))


def test_lower_quantile(spark):
    rows = spark.createDataFrame([(4.0,), (1.0,), (1.0,), (3.0,), (None,)], "x double")
    assert windows.lower_quantile(rows, "x", "m").first().m == 1.0
    assert windows.lower_quantile(rows.filter("x > 1"), "x", "m").first().m == 3.0
    assert windows.lower_quantile(rows.limit(0), "x", "m").first().m is None


def test_metrics_are_the_union_of_the_keys(spark):
    rows = spark.createDataFrame([({"a": 1.0, "b": float("nan")},), ({"a": 3.0, "c": 2.0},), (None,), ({"d": None},)], "m map<string,double>")
    assert {(r.metric, r["mean"], r.n) for r in aggregates.means_of_records(rows, "m").collect()} == {("a", 2.0, 2), ("c", 2.0, 1)}


def test_gradient_counts_valid_neighbours_only(spark):
    cells = [(0, y, x, float(x * x + 3 * y), 0.0, 2.0, (y, x) != (1, 1)) for y in range(2) for x in range(3)] + [(1, 0, 0, 5.0, 0.0, 1.0, True)]
    px = spark.createDataFrame(cells, "image int, y int, x int, pred double, gt double, conf double, ok boolean")
    got = {r.image: (r.grad_w, r.grad_h, r.loss_grad) for r in metrics.gradient_loss(px, ["image"], "y", "x", "pred", "gt", "conf", F.col("ok")).collect()}
    assert got == {0: (2 * (1 + 3) / 2, 6.0, 10.0), 1: (0.0, 0.0, 0.0)}


def test_sinks_write_failures_and_a_marker(spark, tmp_path):
    rows = spark.createDataFrame([("s", "b", 1), ("s", "a", 2)], "subset string, scene string, n int")
    documents.write_index(rows, f"{tmp_path}/index", rows.limit(0))
    assert not (tmp_path / "index.failures").exists()
    documents.write_index(rows, f"{tmp_path}/index", rows.limit(1))
    assert spark.read.json(f"{tmp_path}/index.failures").count() == 1
    assert not documents.is_complete(spark, f"{tmp_path}/scenes")
    documents.write_scenes(rows, f"{tmp_path}/scenes", ["subset"])
    assert documents.is_complete(spark, f"{tmp_path}/scenes") and (tmp_path / "scenes" / "subset=s").exists()
    (tmp_path / "scenes" / "_SUCCESS").unlink()
    assert not documents.is_complete(spark, f"{tmp_path}/scenes")

"""Rounds of k-means: what a round costs follows the numbers in the vectors, and every row counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import clustering as C


def plain(ids, x, k, seed, n_init, max_iter=300, tol=1e-6):
    """The same draws and rounds over one matrix."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    best, best_cos = None, -np.inf
    for run in range(n_init):
        c, before = np.zeros((0, x.shape[1])), None
        for step in range(k):
            far = np.maximum(0.0, 2 - 2 * (x @ c.T).max(1)) if len(c) else np.ones(len(x))
            u = np.array([C.hash_id(i, seed * 1_000_003 + run * 1009 + step) for i in ids])
            c = np.vstack([c, x[np.where(far > 1e-15, -np.log(u) / np.maximum(far, 1e-300), np.inf).argmin()]])
        for _ in range(max_iter):
            sim = x @ c.T
            label, cos = sim.argmax(1), sim.max(1)
            if cos.sum() > best_cos:
                best, best_cos = c, cos.sum()
            sums = np.stack([x[label == j].sum(0) if (label == j).any() else x[cos.argmin()] for j in range(k)])
            new = sums / np.linalg.norm(sums, axis=1, keepdims=True)
            state = (np.bincount(label, minlength=k).tolist(), round(float(cos.sum()), 9))
            if 1 - (new * c).sum(1).mean() < tol or state == before:
                break
            c, before = new, state
    return (x @ best.T).argmax(1), (x @ best.T).max(1)


def test_rounds_do_not_run_a_task_for_each_partition_of_the_input(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, rng.standard_normal(16).tolist()) for i in range(400)], "scene long, centroid array<double>").repartition(60, "scene")
    sc = spark.sparkContext
    sc.setJobGroup("kmeans-rounds", "tasks of the rounds")
    try:
        assert C.spherical_kmeans(df, 5, n_init=2).count() == 400
        jobs = sc.statusTracker().getJobIdsForGroup("kmeans-rounds")
        infos = [sc.statusTracker().getStageInfo(s) for j in jobs for s in sc.statusTracker().getJobInfo(j).stageIds]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
    many = [i.numTasks for i in infos if i and i.numCompletedTasks >= 60]
    assert len(jobs) > 10 and len(many) <= 4, (len(jobs), many)


@pytest.mark.parametrize("parts", [1, 7])
def test_rows_of_many_blocks_equal_a_plain_run(spark, parts):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((6000, 64)) + 2 * rng.standard_normal((6, 64))[rng.integers(6, size=6000)]
    ids = [2**53 + 1 + i for i in range(len(x))]
    assert len(x) * 64 > 2 * C.BLOCK
    df = spark.createDataFrame(list(zip(ids, x.tolist(), strict=True)), "scene long, centroid array<double>").repartition(parts, "scene")
    got = sorted((r["scene"], r["cluster"], r["cosine"]) for r in C.spherical_kmeans(df, 6, n_init=2).collect())
    label, cosine = plain(ids, x, 6, 0, 2)
    assert [g[0] for g in got] == ids
    assert np.allclose([g[2] for g in got], cosine, atol=1e-9)
    pairs = set(zip([g[1] for g in got], label.tolist(), strict=True))
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_rows_without_a_key_and_other_types_stay(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (1, [0.0, 2.0]), (2**60 + 1, [0.0, 0.0])], "scene long, centroid array<float>")
    got = C.spherical_kmeans(df, 2, n_init=1)
    assert {r["scene"] for r in got.collect()} == {None, 1, 2**60 + 1}
    assert got.filter(F.col("cosine").isNull()).count() == 0

"""The number of communities follows the data."""

import numpy as np
import pytest

from lumenfold.operators import clustering as C
from lumenfold.operators import stats as ST
from lumenfold.operators import vectors as V
from lumenfold.plans import catalog


def alone_quality(x, gamma):
    w = x @ x.T + 1
    np.fill_diagonal(w, 0)
    return float(-gamma * ((w.sum(1) / w.sum()) ** 2).sum())


def test_not_worse_than_all_scenes_alone(spark):
    d = "/root/testdata/sf0.01"
    ready = catalog._ready(spark, d).drop("cluster")
    got = catalog.queries()["communities"](spark, d)
    quality = V.modularity(ready.join(got, "scene"), "cluster", gamma=2.0).first()["modularity"]
    assert quality >= alone_quality(np.array(ready.toArrow()["centroid"].to_pylist()), 2.0) - 1e-9
    assert got.select("cluster").distinct().count() > 32


@pytest.mark.parametrize("start", [None, 2])
def test_more_groups_than_the_start(spark, start):
    rng = np.random.default_rng(3)
    base = np.eye(40) * 3
    data = [(k, (base[k % 40] + 0.01 * rng.standard_normal(40)).tolist(), k % 40) for k in range(160)]
    df = spark.createDataFrame(data, "scene long, centroid array<double>, t int")
    got = C.communities(df.drop("t"), gamma=2.0, start=start)
    assert ST.adjusted_rand(got.join(df, "scene"), "cluster", "t").first()["ari"] == pytest.approx(1.0)

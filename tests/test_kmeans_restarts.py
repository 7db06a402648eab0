"""The registered k-means has the restarts and rounds of its reference."""

import inspect

import numpy as np

from lumenfold.operators import clustering as C


def test_more_restarts_are_never_worse_and_ten_is_the_default(spark):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(k, rng.standard_normal(16).tolist()) for k in range(200)], "scene long, centroid array<double>").coalesce(2)
    total = {n: sum(r["cosine"] for r in C.spherical_kmeans(df, 8, **({"n_init": n} if n else {})).collect()) for n in (1, 3, 10, None)}
    assert total[1] <= total[3] + 1e-9 and total[3] <= total[10] + 1e-9 and abs(total[10] - total[None]) < 1e-9
    assert total[10] > total[1] + 1e-6
    assert inspect.signature(C.spherical_kmeans).parameters["max_iter"].default == 300

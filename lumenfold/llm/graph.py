"""Connected components of a link table, with nothing gathered on the driver.

Links are first contracted inside each partition by union-find, so a dense group
leaves one link a member. Then large-star and small-star steps alternate until every
node points at the smallest id of its component. Minima come from aggregates that
combine before the shuffle, and a hub's links are split by adaptive skew joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, keep


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (p := up.setdefault(root, root)) != root:
            root = p
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    def flush() -> pa.RecordBatch:
        pairs = [(x, r) for x in list(up) if (r := find(x)) != x]
        up.clear()
        cols = np.array(pairs, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(cols[:, 0]), pa.array(cols[:, 1])], names=["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                up[max(x, y)] = min(x, y)
        if len(up) > 1_000_000:  # bounded memory: what is known so far leaves as links
            yield flush()
    yield flush()


def components(links: DataFrame) -> DataFrame:
    """node, component_id for every node that is linked to another. ``links``: two id columns.

    component_id is the smallest id of the component. Self-links and repeats do no harm.
    """
    a, b = links.columns[:2]
    e = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v")
    e = keep(e.mapInArrow(_contract, "u long, v long"), "links")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # In ``large`` every u has smaller neighbours only.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        done = keep(small.filter("u <> v").distinct(), "links")
        drop(e)
        e = done
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component_id")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct())

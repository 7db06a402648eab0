"""Incremental work: idempotent reruns, upserts of a table, log windows as a stream."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenfold import schemas
from lumenfold.operators.joins import upsert


def still_to_do(tasks: DataFrame, done: DataFrame | None, keys: list[str], overwrite: bool = False) -> DataFrame:
    """Tasks whose keys have no output yet; all of them with ``overwrite``."""
    return tasks if overwrite or done is None else tasks.join(done.select(*keys).distinct(), keys, "left_anti")


def upsert_table(spark: SparkSession, path: str, attempted: DataFrame, keys: list[str], columns: list[str], version: int) -> str:
    """Write version ``version`` of a table with attempted keys replaced; the older version stays readable until swapped."""
    new = f"{path}/v{version}"
    upsert(spark.read.parquet(f"{path}/v{version - 1}"), attempted, keys, columns).write.mode("errorifexists").parquet(new)
    return new


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    """Lines appended to JSON-lines logs in a folder."""
    return spark.readStream.schema(schemas.TRAIN_LOG).json(path)


def window_means(log: DataFrame, run: str, every: int, metric: str = "loss") -> DataFrame:
    """run, window, n, mean as a stream: means over every ``every`` rows of a run, then a reset. A row leaves when its window is full."""

    def update(key, frames, state: GroupState):
        n, total, window = state.get if state.exists else (0, 0.0, 0)
        out = []
        for frame in frames:
            for x in frame[metric]:
                n, total = n + 1, total + float(x)
                if n == every:
                    out.append((key[0], window, n, total / n))
                    n, total, window = 0, 0.0, window + 1
        state.update((n, total, window))
        yield pd.DataFrame(out, columns=["run", "window", "n", "mean"])

    return log.groupBy(run).applyInPandasWithState(update, "run string, window long, n long, mean double", "n long, total double, window long", "append", GroupStateTimeout.NoTimeout)


def event_counts(events: DataFrame, ts: str, key: str, size: str, late: str) -> DataFrame:
    """Counts of event-time windows with a watermark. Engine surface: the built-in, not an operator of its own."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), key).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    """Session windows with a watermark. Engine surface, as above."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))


def apply_batches(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run ``write`` on each micro-batch; with the batch number as version, a repeated batch rewrites the same output."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()

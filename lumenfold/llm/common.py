"""Shared plumbing of the training-data operators.

* ``table`` reads one input table through Spark's reader only.
* ``keep`` cuts lineage with a Parquet table in the folder the cluster names in
  ``spark.checkpoint.dir``; a lost executor then re-reads files, not its own disk.
* ``drop`` deletes such a table once no later plan reads it.
"""

from __future__ import annotations

import atexit
import re
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    The session's ``spark.checkpoint.dir`` wins, then the context's checkpoint
    folder. Where neither is set, a temporary folder is made and set if everything runs
    on one machine, as in tests; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all machines of the cluster see")
    made = tempfile.mkdtemp(prefix="lumenfold-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Rows in an Arrow batch where rows hold whole texts, and bytes in one: a batch is a few MB, or one longer text.
TEXT_ROWS, TEXT_BYTES = 1000, 4 << 20
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _setting(spark: SparkSession, name: str) -> str | None:
    try:
        return spark.conf.get(name)  # the default of a setting that this Spark knows
    except PySparkException:
        return None


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside the block; those this Spark does not know are left out."""
    known = {k: v for k in values if (v := _setting(spark, k)) is not None}
    for k in known:
        spark.conf.set(k, values[k])
    try:
        yield
    finally:
        for k, v in known.items():
            spark.conf.set(k, v)


def keep(df: DataFrame, label: str, texts: bool = False) -> DataFrame:
    """Write ``df`` below the shared folder and return it reread from there.

    Shuffle files of the write go as soon as it is done, not when the driver happens to
    collect garbage. ``texts``: whole texts pass through Python on the way, so batches are smaller.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/lumenfold/{label}-{uuid.uuid4().hex}"
    now = {_CLEAN: "true"}
    if texts:
        now[_BATCH] = str(min(TEXT_ROWS, int(spark.conf.get(_BATCH))))
        now[_BATCH_BYTES] = str(TEXT_BYTES)
    with settings(spark, now):
        df.write.parquet(path)
    _OWN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lumenfold_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete tables written by ``keep`` that no later plan reads."""
    for df in frames:
        path = getattr(df, "_lumenfold_path", None)
        if path and path in _OWN:
            _delete(df.sparkSession, path)
            _OWN.remove(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None or sys.is_finalizing():
        return
    for path in list(_OWN):
        try:
            _delete(spark, path)
        except Exception:  # the context is already gone at exit
            return


#: Words of 64 bits in a membership filter, 2 to this power at most: 64 MB, whatever the number of keys.
MOST_FILTER_WORDS = 23


def _bit_places(key: Column, log2: int) -> list[Column]:
    """Two places of a key among 2 ** (log2 + 6) bits."""
    return [F.shiftrightunsigned(F.xxhash64(key, F.lit(salt)), 58 - log2) for salt in (1, 2)]


def may_hold(df: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """``df`` with a boolean column: whether ``key`` may be in ``keys`` (one long column); never false for one that is.

    The filter has about 16 bits a key and a fixed upper bound, and travels as a single row. It is
    read inside generated code. With so many keys that it would let most rows pass, all are true.
    """
    spark = df.sparkSession
    known = keys.select(F.col(keys.columns[0]).cast("long").alias("k")).filter("k is not null")
    n = known.count()
    if n > 1 << (MOST_FILTER_WORDS + 4):  # fewer than four bits a key
        return df.withColumn(name, F.lit(True))
    log2 = min(MOST_FILTER_WORDS, max(6, (n * 16 // 64).bit_length()))
    place = F.explode(F.array(*_bit_places(F.col("k"), log2)))
    got = known.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("word")).toArrow()
    words = np.zeros(1 << log2, np.int64)
    words[got["at"].to_numpy()] = got["word"].to_numpy()
    held = fresh_name(df, "filter_words")
    row = pa.table({held: pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(words))})
    met = df.crossJoin(F.broadcast(spark.createDataFrame(row)))  # one row, of a fixed bound
    one, two = (F.getbit(F.get(F.col(held), F.shiftright(p, 6).cast("int")), p.bitwiseAND(63).cast("int")) for p in _bit_places(key, log2))
    return met.withColumn(name, F.coalesce((one == 1) & (two == 1), F.lit(False))).drop(held)


def prefilter(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be in ``keys``. Wide rows that no join needs go in the scan, before any shuffle."""
    name = fresh_name(df, "maybe")
    return may_hold(df, key, keys, name).filter(F.col(name)).drop(name)


def row_key(id_col: Column, text_key: Column) -> Column:
    """What a row of documents is known by, as one long: its id (null or not) and the hash of its text."""
    return F.xxhash64(F.coalesce(id_col.cast("long"), F.lit(-1)), id_col.isNull(), text_key)


def _same_row(df_id: Column, df_key: Column, id_name: str, key_name: str) -> Column:
    return df_id.cast("long").eqNullSafe(F.col(id_name)) & (df_key == F.col(key_name))


def split_rows(df: DataFrame, named: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: str = "left_anti") -> tuple[DataFrame, DataFrame]:
    """(rows of ``df`` surely not in ``named``, rows that may be: joined with it by ``how``).

    ``named`` has doc_id and text_key (``xxhash64`` of the text): rows are known by both, so rows that share an id
    but not a text, and rows without an id, are told apart. Only the second part is ever shuffled.
    """
    names = fresh_name(df, "named_id"), fresh_name(df, "named_text"), fresh_name(df, "maybe")
    text_key = F.xxhash64(F.col(text_col))
    few = named.select(F.col("doc_id").cast("long").alias(names[0]), F.col("text_key").alias(names[1]))
    told = may_hold(df, row_key(F.col(id_col), text_key), few.select(row_key(F.col(names[0]), F.col(names[1])).alias("k")), names[2])
    # The flag in the join's condition keeps the optimizer from joining all rows before the filter.
    met = told.filter(F.col(names[2])).join(few.distinct(), F.col(names[2]) & _same_row(F.col(id_col), text_key, names[0], names[1]), how)
    return told.filter(~F.col(names[2])).drop(names[2]), met.drop(*names)


def without(df: DataFrame, named: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``df`` that ``named`` (doc_id, text_key) does not name."""
    never, rest = split_rows(df, named, id_col, text_col)
    return never.unionByName(rest)


def once(df: DataFrame, named: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with a single row for each document that ``named`` (doc_id, text_key) names. All other rows pass by."""
    if named.isEmpty():
        return df
    name = fresh_name(df, "one_text")
    _, met = split_rows(df, named, id_col, text_col, "left_semi")
    single = met.withColumn(name, F.xxhash64(F.col(text_col))).dropDuplicates([id_col, name]).drop(name)
    return without(df, named, id_col, text_col).unionByName(single)


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base

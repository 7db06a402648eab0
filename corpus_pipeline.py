"""From raw documents to a mixed training set, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what a
stage returns as Parquet in the shared folder and rereads it as the next one's docs.
All stages but the last return the columns of ``documents``.

1. quality classifier: documents that it rejects go.
2. MinHash near-dedup: one document of each group of near copies stays (five words, 0.8).
3. benchmark decontamination: documents that hold ten words of a benchmark item go.
4. secret scans: values of credentials are masked; widely copied examples stay.
5. mixing sources to target weights: how often each document is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import decontam, minhash, mixing, quality, secrets
from lumenfold.llm.common import drop, keep, once, table, without


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, unchanged.

    Null, empty and blank texts go. Rows are judged by their text alone: ids may be null or repeat, rows that
    repeat stay or go together, and texts of any length are read whole. Empty table: no rows. Extra columns stay.
    """
    return quality.filter_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8), unchanged: the one with the smallest id, then text hash.

    A row is known by id and text: rows that share an id but not a text are two documents, a null id is no bar to being
    a copy, and of rows that repeat as a whole one stays. Texts without words are linked with nothing and all stay.
    Empty table: no rows. Extra columns stay; where rows with one id and text differ in them, either may stay.
    """
    groups = keep(minhash.near_groups(docs, shingle=5, percent=80), "groups")
    worded = groups.filter("n_shingles > 0")
    again = worded.filter("chosen").groupBy("doc_id", "text_key").count().filter("count > 1").select("doc_id", "text_key")
    return once(without(docs, worded.filter("not chosen").select("doc_id", "text_key")), keep(again, "again"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten words in a row of a benchmark item (nor a whole shorter item), unchanged.

    Each row is judged by its own text, whatever its id; null and empty texts stay. Without benchmark items all rows
    stay. Empty table: no rows. Extra columns stay.
    """
    found = decontam.find(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, keep(found.filter(F.size("items") > 0).select("doc_id", "text_key"), "contaminated"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; values of credentials in their texts are masked, but not those of widely copied examples.

    Null and empty texts stay as they are, null sources are an owner of their own, rows that share an id but not a
    text keep each its own text, and rows that repeat are masked alike. ``n_chars`` follows the text. Empty table: no rows.
    """
    return secrets.redact(docs, repo_col=F.concat_ws("/", "source", "lang"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """For every row how often the mix takes it: doc_id, size, source, source_size, target, copies, taken.

    Null and empty texts have size 0 and are taken 0 times; a null source is a source of its own; rows that repeat are
    mixed each by itself. Empty table: no rows. Extra columns are not carried.
    """
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("mixing sources to target weights", mixing_stage),
]

#: Fitting a scorer and drawing copies are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. Tables of earlier stages go once nothing reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        done = keep(stage(spark, docs, sf_dir), name.split()[0].lower(), texts=True)
        drop(docs)
        docs = done
    return docs

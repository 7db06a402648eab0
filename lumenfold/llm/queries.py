"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import capfilter, chat, decontam, htmltext, minhash, mixing, oracles, quality, secrets, suffix, warc
from .common import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return htmltext.main_text(table(spark, sf_dir, "pages"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, cosine 0.9 or more."""
    return capfilter.near_vectors(table(spark, sf_dir, "embeddings"), least=0.9)


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations plus conversation -1, rendered and read back."""
    asked = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(asked).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.render(chat.canonical_turns(rows)))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans of every document and live spans from ownership over the corpus; owner: source, repository: source and language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", F.concat_ws("/", "source", "lang").alias("repo"))
    return secrets.report(secrets.classify(secrets.scan(docs, repo_col="repo")))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: bytes covered by 100-byte strings that also start earlier."""
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as capture records, each visited again: revisits resolved. Headers as sorted name=value lines."""
    got = warc.resolve_revisits(warc.page_records(table(spark, sf_dir, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return got.select("record_id", "url_key", "ts", "kind", "status", "response_id", "digest", F.array_join(lines, "\n").alias("headers"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored; labels of the table are one labeller."""
    docs = table(spark, sf_dir, "documents")
    return quality.train_and_classify(docs, table(spark, sf_dir, "labels")).drop("text_key")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to source weights 5, 2, 1, repeating."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items, ten words."""
    return decontam.digest(decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: three-word shingles, similarity 0.85 or more."""
    return minhash.near_groups(table(spark, sf_dir, "documents"), shingle=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)

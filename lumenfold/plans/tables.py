"""The driver's tables read as the engine's logical tables. No row is left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N_LAYERS, LAYER_WIDTH = 4, 16


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def feature(spark: SparkSession, d: str) -> DataFrame:
    """Images: four vectors a scene, four layers of sixteen."""
    e = read(spark, d, "embeddings")
    return e.select((F.floor(F.col("vec_id") / 4)).cast("bigint").alias("scene"), (F.col("vec_id") % 4).cast("int").alias("img_no"), F.col("embedding").cast("array<double>").alias("cls"), F.col("label").alias("cluster"))


def members(spark: SparkSession, d: str) -> DataFrame:
    """cluster, scene: a scene has the label of its first image."""
    return feature(spark, d).filter("img_no = 0").select("cluster", "scene")


def eval_window(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation rows: events of a user are the repeats of a scene."""
    e = read(spark, d, "events")
    return e.select(F.col("user_id").alias("scene"), F.col("event_type").alias("run"), "value", F.get_json_object("props", "$.k").cast("double").alias("k"), "ts", "event_id")


def scenes(spark: SparkSession, d: str) -> DataFrame:
    """Documents as scenes; a label says whether there is depth, none says nothing."""
    docs = read(spark, d, "documents").select(F.col("lang").alias("subset"), F.col("doc_id").alias("scene"), F.col("n_chars").alias("num_frames"))
    has = read(spark, d, "labels").select(F.col("doc_id").alias("scene"), (F.col("quality") == 1).alias("has_depth"))
    return docs.join(has, "scene", "left")


def observations(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as observations: frame, point, depth z and error."""
    li = read(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("frame"), F.col("l_partkey").alias("point"), F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("z"), F.col("l_quantity").alias("error"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_suppkey").alias("supp"))


def poses(spark: SparkSession, d: str) -> DataFrame:
    """Predicted and true poses from slices of an embedding; the label and tens of ids make windows."""
    f = read(spark, d, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 10).cast("bigint").alias("window"), F.col("embedding").cast("array<double>").alias("v"))
    names = ("tx", "ty", "tz", "qx", "qy", "qz", "qw")
    pick = lambda base: [F.col("v")[base + k] for k in range(7)]
    cols = [c.alias(f"p_{n}") for n, c in zip(names, pick(0), strict=True)] + [(c + 0.25 * o).alias(f"g_{n}") for n, c, o in zip(names, pick(0), pick(7), strict=True)]
    fov = [(1.0 + 0.5 * F.col("v")[k]).alias(f"{s}_{n}") for k, (s, n) in enumerate([(s, n) for s in "pg" for n in ("fov_h", "fov_w")], 14)]
    return f.select("vec_id", "window", *cols, *fov)

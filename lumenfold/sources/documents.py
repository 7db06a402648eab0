"""JSON, JSON-lines and text sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold import schemas


def scene_index(spark: SparkSession, path: str) -> DataFrame:
    """One row a scene of an index document."""
    return spark.read.schema(schemas.SCENE_INDEX).json(path, multiLine=True).selectExpr("inline(scenes)")


def eval_windows(spark: SparkSession, path: str, metric: str | None = None) -> DataFrame:
    """Evaluation rows of a JSON-lines file; with ``metric``, rows that hold the field. NaN stays NaN, blank lines do not count."""
    rows = spark.read.schema(schemas.EVAL_WINDOW).json(path).filter("scene_id is not null")
    return rows.filter(F.col(f"`{metric}`").isNotNull()) if metric else rows


def clusters(spark: SparkSession, path: str) -> DataFrame:
    """cluster, size, cohesion, ordinal, subset, scene, split, typicality of a cluster document."""
    doc = spark.read.schema(schemas.CLUSTERS).json(path, multiLine=True).select(F.explode("clusters").alias("c"))
    return doc.select("c.cluster", "c.size", "c.cohesion", F.posexplode("c.scenes").alias("ordinal", "s")).select("cluster", "size", "cohesion", "ordinal", "s.*")


def scene_list(spark: SparkSession, path: str) -> DataFrame:
    """subset, scene of a white-space separated list of ``subset/scene``."""
    words = spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("w")).filter("w <> ''")
    return words.select(F.regexp_extract("w", r"^([^/]*)/", 1).alias("subset"), F.regexp_extract("w", r"([^/]*)$", 1).alias("scene")).distinct()


def run_args(spark: SparkSession, path: str) -> DataFrame:
    """name, value of a flat JSON document of flags; values as text."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("name", "value"))


def depth_meta(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.DEPTH_META).json(path, multiLine=True).withColumn("path", F.input_file_name())


def train_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TRAIN_LOG).json(path)


def discover(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """path, length, modified of files below a folder; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return rows.select("path", "length", F.col("modificationTime").alias("modified"))


def first_existing(files: DataFrame, scene: list[str], kind: str, priority: list[str]) -> DataFrame:
    """For each scene the file whose ``kind`` comes first in the list of preferred kinds."""
    place = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(kind))
    return files.filter(place > 0).groupBy(*scene).agg(F.min_by("path", place).alias("path"))


def write_scene_list(scenes: DataFrame, path: str) -> None:
    """``subset/scene`` lines, sorted."""
    scenes.select(F.concat_ws("/", "subset", "scene").alias("value")).orderBy("value").write.mode("overwrite").text(path)


def write_index(scenes: DataFrame, path: str, failures: DataFrame | None = None) -> None:
    """Index rows sorted by subset and scene, as JSON lines; failures, if there are any, in ``path``.failures."""
    scenes.orderBy("subset", "scene").write.mode("overwrite").json(path)
    if failures is not None and not failures.isEmpty():
        failures.orderBy("subset", "scene").write.mode("overwrite").json(f"{path}.failures")


def write_scenes(rows: DataFrame, path: str, by: list[str]) -> None:
    """Columnar rows in one folder for each value of ``by``; the ``_SUCCESS`` marker comes last."""
    rows.write.mode("overwrite").partitionBy(*by).parquet(path)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a folder was written to its end: its marker is there."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def cluster_document(members: DataFrame, method: str) -> DataFrame:
    """One JSON text for each cluster: its scenes in ordinal order, least typical first.

    Columns: cluster, ordinal, subset, scene, typicality, split, cohesion. A cluster's scene list is one value.
    """
    scene = F.struct("ordinal", "subset", "scene", "split", F.round("typicality", 6).alias("typicality"))
    got = members.groupBy("cluster").agg(F.count("*").alias("size"), F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "eval").alias("n_eval"), F.first("cohesion").alias("cohesion"), F.array_sort(F.collect_list(scene)).alias("scenes"))
    scenes = F.transform("scenes", lambda s: s.dropFields("ordinal"))
    return got.select("cluster", F.to_json(F.struct(F.lit(method).alias("method"), "cluster", "size", "n_train", "n_eval", "cohesion", scenes.alias("scenes"))).alias("document"))


def report_page(report: DataFrame, title: str, most: int = 1000) -> str:
    """An HTML table of a bounded report: at most ``most`` rows."""
    import html

    rows = report.limit(most).collect()
    head = "".join(f"<th>{html.escape(c)}</th>" for c in report.columns)
    body = "".join("<tr>" + "".join(f"<td>{'' if v is None else html.escape(f'{v:.4f}' if isinstance(v, float) else str(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><table><tr>{head}</tr>{body}</table>"


def write_windows(windows: DataFrame, summary: DataFrame, path: str) -> None:
    """Evaluation rows as JSON lines, and their one-row summary beside them."""
    windows.write.mode("overwrite").json(f"{path}/windows")
    summary.write.mode("overwrite").json(f"{path}/summary")

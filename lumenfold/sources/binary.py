"""Binary sources: sparse-reconstruction files and array archives.

Files are read by Spark (``binaryFile``), decoded in Arrow batches on executors, one file
at a time. A file that does not decode gives an error row in ``decode_errors``, not a failed job.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold import schemas

#: Fixed values of the file format: model name and number of parameters by model id.
CAMERA_MODELS = {0: ("SIMPLE_PINHOLE", 3), 1: ("PINHOLE", 4), 2: ("SIMPLE_RADIAL", 4), 3: ("RADIAL", 5), 4: ("OPENCV", 8), 5: ("OPENCV_FISHEYE", 8), 6: ("FULL_OPENCV", 12), 7: ("FOV", 5), 8: ("SIMPLE_RADIAL_FISHEYE", 4), 9: ("RADIAL_FISHEYE", 5), 10: ("THIN_PRISM_FISHEYE", 12)}


class Bytes:
    """Little-endian values from a buffer; running out raises."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, layout: str) -> tuple:
        values = struct.unpack_from("<" + layout, self.data, self.at)
        self.at += struct.calcsize("<" + layout)
        return values

    def text(self) -> str:
        end = self.data.index(b"\0", self.at)
        out = self.data[self.at : end].decode()
        self.at = end + 1
        return out

    def block(self, size: int) -> bytes:
        if self.at + size > len(self.data):
            raise ValueError("the file ends early")
        self.at += size
        return self.data[self.at - size : self.at]


def camera_rows(data: bytes) -> list[tuple]:
    b = Bytes(data)
    out = []
    for _ in range(b.take("Q")[0]):
        camera, model, width, height = b.take("iiQQ")
        name, n = CAMERA_MODELS[model]
        out.append((camera, name, width, height, list(b.take("d" * n))))
    return out


_KEYPOINT = np.dtype([("x", "<f8"), ("y", "<f8"), ("point", "<i8")])


def _images(data: bytes) -> Iterator[tuple[tuple, np.ndarray]]:
    b = Bytes(data)
    for _ in range(b.take("Q")[0]):
        image, *pose, camera = b.take("i7di")
        name = b.text()
        n = b.take("Q")[0]
        yield (image, pose[:4], pose[4:], camera, name, n), np.frombuffer(b.block(24 * n), _KEYPOINT)


def image_rows(data: bytes) -> list[tuple]:
    return [row for row, _ in _images(data)]


def keypoint_rows(data: bytes) -> list[tuple]:
    return [(row[0], k, float(p["x"]), float(p["y"]), int(p["point"])) for row, points in _images(data) for k, p in enumerate(points)]


def point_rows(data: bytes) -> list[tuple]:
    b = Bytes(data)
    out = []
    for _ in range(b.take("Q")[0]):
        point, x, y, z, red, green, blue, error, track = b.take("QdddBBBdQ")
        b.block(8 * track)  # pairs of image and keypoint, which the images hold as well
        out.append((point, x, y, z, red, green, blue, error, track))
    return out


def _decode(rows_of: Callable[[bytes], list[tuple]], columns: list[str], strict: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, data in zip(frame.path, frame.content, strict=True):
                try:
                    rows = rows_of(bytes(data))
                except (ValueError, KeyError, struct.error, UnicodeDecodeError) as e:
                    if strict:
                        raise ValueError(f"{path}: {e}") from e
                    continue
                yield pd.DataFrame([(path, *r) for r in rows], columns=columns)

    return run


def _scan(spark: SparkSession, root: str, pattern: str, rows_of: Callable, schema: str, strict: bool) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    names = [c.split()[0] for c in schema.split(", ")]
    return files.select("path", "content").mapInPandas(_decode(rows_of, names, strict), schema)


def cameras(spark: SparkSession, root: str, pattern: str = "cameras.bin", strict: bool = True) -> DataFrame:
    return _scan(spark, root, pattern, camera_rows, schemas.CAMERA, strict)


def images(spark: SparkSession, root: str, pattern: str = "images.bin", strict: bool = True) -> DataFrame:
    return _scan(spark, root, pattern, image_rows, schemas.IMAGE, strict)


def keypoints(spark: SparkSession, root: str, pattern: str = "images.bin", strict: bool = True) -> DataFrame:
    return _scan(spark, root, pattern, keypoint_rows, schemas.KEYPOINT, strict)


def points3d(spark: SparkSession, root: str, pattern: str = "points3D.bin", strict: bool = True) -> DataFrame:
    return _scan(spark, root, pattern, point_rows, schemas.POINT3D, strict)


def model(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The four tables of all reconstructions below a folder."""
    return {"camera": cameras(spark, root), "image": images(spark, root), "keypoint": keypoints(spark, root), "point3d": points3d(spark, root)}


def decode_errors(spark: SparkSession, root: str, pattern: str, rows_of: Callable) -> DataFrame:
    """path, reason of files that do not decode."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, data in zip(frame.path, frame.content, strict=True):
                try:
                    rows_of(bytes(data))
                except Exception as e:  # any failure is the answer here
                    yield pd.DataFrame({"path": [path], "reason": [f"{type(e).__name__}: {e}"]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", "content").mapInPandas(run, "path string, reason string")


def array_archive(spark: SparkSession, root: str, vector: str, keys: dict[str, str], pattern: str = "*.npz") -> DataFrame:
    """Rows of .npz archives: one row along the first axis of ``vector``, with ``keys`` (array name -> SQL type) beside it."""
    names = list(keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, data in zip(frame.path, frame.content, strict=True):
                with np.load(io.BytesIO(bytes(data)), allow_pickle=False) as z:
                    x = np.asarray(z[vector], np.float64)
                    out = {"path": [path] * len(x)} | {k: z[k].tolist() for k in names}
                    out["row"] = list(range(len(x)))
                    out["vector"] = list(x.reshape(len(x), -1))
                    yield pd.DataFrame(out)[["path", *names, "row", "vector"]]

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    kinds = "".join(f"{k} {t}, " for k, t in keys.items())
    return files.select("path", "content").mapInPandas(run, f"path string, {kinds}row int, vector array<double>")


def depth_frames(pixels: DataFrame, meta: DataFrame, keys: list[str]) -> DataFrame:
    """Depth of stored codes; null at both ends of the range and for frames without depth."""
    from lumenfold.functions.scalar import dequantise_log

    return pixels.join(meta.select(*keys, "lo", "hi"), keys, "left").withColumn("depth", dequantise_log(F.col("q"), F.col("lo"), F.col("hi"))).drop("lo", "hi")


def predict(images: DataFrame, path: str, make_model: Callable, schema: str, batch: int = 8) -> DataFrame:
    """The model seam: ``make_model()`` gives a function from a list of paths to a list of result tuples; it is made once a task."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make_model()
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame[path].iloc[at : at + batch].tolist()
                yield pd.DataFrame([(p, *r) for p, r in zip(part, call(part), strict=True)], columns=["path", *names])

    return images.select(path).mapInPandas(run, f"path string, {schema}")

"""Readers over synthesised files, sinks and streams."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.sources import binary, documents
from lumenfold.streaming import incremental


@pytest.fixture
def colmap(tmp_path):
    cam = struct.pack("<Q", 2) + struct.pack("<iiQQ4d", 1, 1, 640, 480, 500, 501, 320, 240) + struct.pack("<iiQQ3d", 2, 0, 64, 48, 50, 32, 24)
    img = struct.pack("<Q", 2)
    img += struct.pack("<i7di", 7, 1, 0, 0, 0, 0.1, 0.2, 0.3, 1) + b"a.png\0" + struct.pack("<Q", 0)
    img += struct.pack("<i7di", 8, 1, 0, 0, 0, 0, 0, 0, 2) + b"b.png\0" + struct.pack("<Q", 3) + struct.pack("<ddqddqddq", 1, 2, 5, 3, 4, -1, 5, 6, 9)
    pts = struct.pack("<Q", 1) + struct.pack("<QdddBBBdQ", 5, 1, 2, 3, 10, 20, 30, 0.5, 2) + struct.pack("<4i", 8, 0, 7, 1)
    for name, data in (("cameras.bin", cam), ("images.bin", img), ("points3D.bin", pts)):
        (tmp_path / name).write_bytes(data)
    return tmp_path


def test_reconstruction_files(spark, colmap):
    m = binary.model(spark, str(colmap))
    assert [tuple(r[1:]) for r in m["camera"].orderBy("camera_id").collect()] == [(1, "PINHOLE", 640, 480, [500, 501, 320, 240]), (2, "SIMPLE_PINHOLE", 64, 48, [50, 32, 24])]
    assert [(r["name"], r["n_keypoints"]) for r in m["image"].orderBy("image_id").collect()] == [("a.png", 0), ("b.png", 3)]
    assert [(r["ordinal"], r["point3d_id"]) for r in m["keypoint"].orderBy("ordinal").collect()] == [(0, 5), (1, -1), (2, 9)]
    p = m["point3d"].first()
    assert (p["point_id"], p["r"], p["error"], p["track_length"]) == (5, 10, 0.5, 2)


def test_broken_file_is_reported(spark, colmap):
    (colmap / "sub").mkdir()
    (colmap / "sub" / "cameras.bin").write_bytes(b"\x05\0\0")
    assert binary.cameras(spark, str(colmap), strict=False).count() == 2
    assert binary.decode_errors(spark, str(colmap), "cameras.bin", binary.camera_rows).count() == 1


def test_array_archive(spark, tmp_path):
    np.savez(tmp_path / "f.npz", cls=np.arange(12.0).reshape(3, 4), scenes=np.array(["a", "b", "c"]))
    got = binary.array_archive(spark, str(tmp_path), "cls", {"scenes": "string"}).orderBy("row").collect()
    assert [(r["scenes"], r["vector"]) for r in got] == [("a", [0, 1, 2, 3]), ("b", [4, 5, 6, 7]), ("c", [8, 9, 10, 11])]


def test_json_sources(spark, tmp_path):
    (tmp_path / "index.json").write_text(json.dumps({"num_train": 1, "scenes": [{"subset": "1K", "scene": "x", "split": "train", "num_frames": 3, "image_hw": [2, 3]}, {"subset": "2K", "scene": "y"}]}))
    assert [(r["subset"], r["num_frames"]) for r in documents.scene_index(spark, str(tmp_path / "index.json")).orderBy("subset").collect()] == [("1K", 3), ("2K", None)]
    (tmp_path / "w.jsonl").write_text('{"scene_id": "a", "loss": NaN}\n\n{"scene_id": "a", "loss": 2.0}\n{"scene_id": "b"}\n')
    assert documents.eval_windows(spark, str(tmp_path / "w.jsonl")).count() == 3
    assert documents.eval_windows(spark, str(tmp_path / "w.jsonl"), "loss").count() == 2
    (tmp_path / "c.json").write_text(json.dumps({"clusters": [{"cluster": 0, "size": 2, "cohesion": None, "scenes": [{"subset": "1K", "scene": "a"}, {"subset": "1K", "scene": "b"}]}]}))
    assert [(r["ordinal"], r["scene"]) for r in documents.clusters(spark, str(tmp_path / "c.json")).orderBy("ordinal").collect()] == [(0, "a"), (1, "b")]
    (tmp_path / "list.txt").write_text("1K/a  2K/b\n\n1K/a\n")
    assert documents.scene_list(spark, str(tmp_path / "list.txt")).count() == 2
    (tmp_path / "args.json").write_text('{"lr": 0.1, "betas": [0.9, 0.95], "resume": null}')
    assert {r["name"]: r["value"] for r in documents.run_args(spark, str(tmp_path / "args.json")).collect()}["betas"] == "[0.9,0.95]"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1, "1K", "b", 0.5, "train", 0.2), (0, 0, "1K", "a", 0.1234567, "eval", 0.2)], "cluster int, ordinal int, subset string, scene string, typicality double, split string, cohesion double")
    documents.write_scene_list(rows, str(tmp_path / "list"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "list")).collect()] == ["1K/a", "1K/b"]
    doc = json.loads(documents.cluster_document(rows, "kmeans").first()["document"])
    assert [s["scene"] for s in doc["scenes"]] == ["a", "b"] and doc["scenes"][0]["typicality"] == 0.123457 and doc["n_train"] == 1
    assert "<td>0.5000</td>" in documents.report_page(rows.select("scene", "typicality"), "t")


def test_model_seam(spark):
    paths = spark.createDataFrame([("a",), ("bb",)], "p string")
    got = binary.predict(paths, "p", lambda: lambda ps: [(len(p),) for p in ps], "n long")
    assert {r["path"]: r["n"] for r in got.collect()} == {"a": 1, "bb": 2}


def test_idempotent_reruns_and_versions(spark, tmp_path):
    tasks = spark.createDataFrame([(1,), (2,)], "k int")
    assert incremental.still_to_do(tasks, tasks.limit(1), ["k"]).count() == 1
    assert incremental.still_to_do(tasks, tasks, ["k"], overwrite=True).count() == 2
    tasks.withColumn("n", F.lit(0)).write.parquet(f"{tmp_path}/t/v0")
    new = incremental.upsert_table(spark, f"{tmp_path}/t", spark.createDataFrame([(2, 7)], "k int, n int"), ["k"], ["n"], 1)
    assert [tuple(r) for r in spark.read.parquet(new).orderBy("k").collect()] == [(1, 0), (2, 7)]


def test_log_stream_windows(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "0.jsonl").write_text("".join(json.dumps({"step": k, "split": "a", "loss": float(k)}) + "\n" for k in range(1, 8)))
    stream = incremental.window_means(incremental.log_stream(spark, str(log)), "split", 3)
    q = stream.writeStream.format("memory").queryName("lumenfold_windows").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.sql("SELECT * FROM lumenfold_windows ORDER BY window").collect()] == [("a", 0, 3, 2.0), ("a", 1, 3, 5.0)]


def test_event_time_surface(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    assert incremental.event_counts(events, "ts", "event_type", "1 day", "1 hour").count() > 0
    assert incremental.sessions(events, "ts", "user_id", "1 hour", "1 hour").count() > 0

"""The corpus pipeline, stage by stage."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from lumenfold.llm import common


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents")
    columns, before = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert out.columns == columns
        assert 0 < out.count() <= before
        docs, before = out, out.count()
    kept = spark.read.parquet(f"{tmp_path}/1")
    assert kept.select("text").distinct().count() == kept.count()
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    bench = {" ".join(w[i : i + 10]) for r in common.table(spark, sf, "benchmark").collect() for w in [words(r["text"])] for i in range(max(1, len(w) - 9))}
    for r in spark.read.parquet(f"{tmp_path}/2").collect():
        w = words(r["text"])
        assert not any(" ".join(w[i : i + 10]) in bench for i in range(len(w) - 9))
    for r in spark.read.parquet(f"{tmp_path}/3").collect():
        assert r["n_chars"] == len(r["text"])


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "size", "target", "taken"} <= set(out.columns) and out.count() > 0


def test_empty_documents(spark):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "/root/testdata/sf0.001").count() == 0


def _rows(spark, sf):
    """Null ids, an id with two texts, rows that repeat, ties, a very long text, clashing names."""
    bench = common.table(spark, sf, "benchmark").orderBy("item_id").first()["text"]
    plain = "The report of the committee is that it was made for this and with the help of {0} others in the end of the day {0}."
    base = " ".join(plain.format(f"word{k}") for k in range(12))
    other = " ".join(plain.format(f"thing{k}") for k in range(12))
    third = " ".join(plain.format(f"item{k}") for k in range(12))
    dirty = other.replace("thing", "stuff") + " " + bench
    rows = [(0, base), (1, base), (1, other), (None, third), (None, third + " x"), (None, dirty), (2, "unique " + third.replace("item", "piece")), (2, "unique " + third.replace("item", "piece"))]
    rows += [(3, (base.replace("word", "long") + " ") * 300), (4, None), (5, ""), (6, "secret = Ab3dEf6hIj9kLm0Q " + base.replace("word", "cell"))]
    made = spark.createDataFrame([(i, t, "en", "s" if i != 6 else None, len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    return made.withColumns({c: F.lit(1) for c in ("maybe", "text_key", "named_id", "id", "row", "kept", "size", "found", "k")}), rows, (base, other, third, dirty)


def test_stages_know_rows_by_id_and_text(spark):
    sf = "/root/testdata/sf0.001"
    docs, rows, (base, other, third, dirty) = _rows(spark, sf)
    stages = dict(corpus_pipeline.STAGES)
    pairs = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=str)

    got = stages["quality classifier"](spark, docs, sf)
    assert got.columns == docs.columns
    assert {t for _, t in pairs(got)} >= {base, other, third} and not any(not t for _, t in pairs(got))

    got = stages["MinHash near-dedup"](spark, docs, sf)
    left = pairs(got)
    assert got.columns == docs.columns
    assert (1, other) in left and (0, base) in left and (1, base) not in left  # an id with two texts loses the copy alone
    assert sum(t.startswith(third) for _, t in left if t) == 1  # copies without an id
    assert sum(i == 2 for i, _ in left) == 1 and {(4, None), (5, "")} <= set(left)
    assert len(left) == len(rows) - 3

    got = stages["benchmark decontamination"](spark, docs, sf)
    assert got.columns == docs.columns
    assert (None, dirty) not in pairs(got) and len(pairs(got)) == len(rows) - 1

    got = stages["secret scans"](spark, docs, sf)
    assert got.columns == docs.columns and got.count() == len(rows)
    assert all((r["n_chars"] or 0) == len(r["text"] or "") for r in got.collect())
    assert "Ab3dEf6hIj9kLm0Q" not in next(t for i, t in pairs(got) if i == 6)

    got = stages["mixing sources to target weights"](spark, docs, sf).collect()
    assert len(got) == len(rows) and all(r["taken"] <= 3 * r["size"] for r in got)

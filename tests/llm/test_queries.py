"""Registered queries against DuckDB or brute force on the small tables."""

import hashlib
import re

import numpy as np
import pytest

from lumenfold.llm import oracles, queries


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_matches_sql(spark, sf, duck, compare, name):
    compare(queries.queries()[name](spark, sf).toArrow(), duck.sql(oracles.SQL[name]).to_arrow_table())


def test_all_ten_are_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries())
    assert numbers == list(range(1, 11))


@pytest.fixture(scope="module")
def documents(spark, sf):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_secret_spans(spark, sf, documents):
    patterns = (("assign", 12, re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")), ("access", 18, re.compile("AKIA[A-Z0-9]+")), ("hex", 16, re.compile("[0-9a-f]+")))
    for r in queries.op4_secret_scans(spark, sf).collect():
        found = sorted((m.start(), k, m.end()) for k, (_, least, p) in enumerate(patterns) for m in p.finditer(documents[r["doc_id"]]["text"] or "") if len(m.group(2) if k == 0 else m.group()) >= least)
        base = ",".join(f"{patterns[k][0]}:{a}:{b}" for a, k, b in found)
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))


def test_repeated_bytes(spark, sf, documents):
    got = {r["doc_id"]: r for r in queries.op5_suffix_array_dedup(spark, sf).collect()}
    seen = set()
    for doc in sorted(documents):
        data = (documents[doc]["text"] or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - 99):
            g = data[s : s + 100]
            if g in seen:
                gone[s : s + 100] = True
            seen.add(g)
        r = got[doc]
        assert (r["n_bytes"], r["n_removed"]) == (len(data), int(gone.sum()))
        assert r["n_spans"] == int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        assert r["kept_sha256"] == hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest()


def test_mixture_meets_its_targets(spark, sf, documents):
    first, second = (sorted(map(tuple, queries.op8_source_mixing(spark, sf).collect())) for _ in range(2))
    assert first == second
    rows = queries.op8_source_mixing(spark, sf).toPandas()
    sizes = {d: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for d, r in documents.items()}
    assert all(sizes[d] == n for d, n in zip(rows.doc_id, rows["size"], strict=True))
    assert (rows.taken <= 3 * rows["size"]).all() and (rows.taken % rows["size"].clip(lower=1) == 0).all()
    by = rows.groupby("source").agg(size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(by.index))}
    total, capped = by["size"].sum(), set()
    while True:
        free = total - sum(3 * by["size"][s] for s in capped)
        level = free / sum(w for s, w in weights.items() if s not in capped)
        over = {s for s, w in weights.items() if s not in capped and level * w > 3 * by["size"][s]}
        if not over:
            break
        capped |= over
    for s in by.index:
        assert by.target[s] == pytest.approx(3 * by["size"][s] if s in capped else level * weights[s])
    assert (abs(by.taken - by.target) <= 0.02 * by.target + 200).all()


def test_main_text_of_pages(spark, sf):
    import html

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.op1_html_extraction(spark, sf).collect():
        article = pages[r["page_id"]].partition("<article>")[2].partition("</article>")[0].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_classifier_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op7_quality_classifier(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    right = sum((got[r["doc_id"]]["score"] >= 0.5) == bool(r["quality"]) for r in labels)
    assert right >= 0.97 * len(labels)
    clean = [got[r["doc_id"]] for r in labels if r["quality"] and not r["toxic"]]
    assert sum(g["kept"] for g in clean) >= 0.98 * len(clean)

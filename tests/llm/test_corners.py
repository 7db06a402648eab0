"""Nulls, empty and long texts, ties, repeats, empty tables, clashing names: defined results."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenfold.llm import capfilter, chat, common, decontam, graph, htmltext, minhash, mixing, quality, secrets, suffix, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EMPTY = hashlib.sha256(b"").hexdigest()


def docs(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in texts], DOCS)


def clashing(df):
    """Extra columns with the names that operators use inside."""
    return df.withColumns({c: F.lit(1) for c in ("row", "size", "gram", "v", "n", "row_", "_row", "component_id", "hash", "a", "b", "kept", "found", "doc", "id", "spans", "base", "target", "score")})


def words(n, seed=0, vocabulary=5000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


# ---------------------------------------------------------------- 1 pages

PAGE = "<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class='cookie notice'>We use cookies</div><main><article><h1>Head &amp; line</h1><p>First  {0}\n para</p><form>mail <input></form><p>Second &lt;b&gt; <b>bo</b>ld</p><script>var a='</p>';</script><section class=comments><p>reader says</p></section></article></main><aside><p>side</p></aside><footer>foot</footer></body></html>"


def test_pages(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(i)) for i in range(5)]
    rows += [(10, "http://h.example/null", None), (11, None, PAGE.format("x")), (12, "http://other/", ""), (13, "http://h.example/0", "<p>un<p>closed <nav>menu</nav>tail <"), (0, "http://h.example/0", PAGE.format(0))]
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = htmltext.main_text(df).collect()
    assert len(got) == len(rows)
    text = {r["page_id"]: r["text"] for r in got}
    assert text[1] == "Head & line\nFirst 1 para\nSecond <b> bold"
    assert text[11] == "Head & line\nFirst x para\nSecond <b> bold"
    assert text[10] == "" and text[12] == "" and text[13] == "un\nclosed\ntail <"
    assert sum(r["page_id"] == 0 for r in got) == 2
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert htmltext.main_text(df.limit(0)).count() == 0


def test_copied_pages_keep_their_articles(spark):
    rows = [(i, "http://copy.example/a", PAGE.format("same")) for i in range(6)]
    got = htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {"Head & line\nFirst same para\nSecond <b> bold"}


def test_levels_and_reader_comments(spark):
    page = "<main><p>around</p><article class=post><header class=entry-header><h1>Title</h1></header><p>Body</p><div id=comments><article class=comment><p>said</p></article></div></article></main>"
    assert htmltext.extract(page, None)[0] == "Title\nBody"
    assert htmltext.extract("<div role=main><p>a</p></div><p>b</p>", None)[0] == "a"
    assert htmltext.extract("<nav>x<article><p>y</p></article>", None)[0] == "y"
    assert htmltext.extract("a &nbsp; b<br>c<table><tr><td>d<td>e</table>&#x41;&eacute;", None)[0] == "a b c\nd\ne\nAé"


def test_template_text_goes_without_an_article(spark):
    page = "<body><div class=top>Logo</div><div class=body><p>Text {0} here</p></div><p>Subscribe now for more</p></body>"
    rows = [(i, "http://t.example/", page.format(i)) for i in range(8)]
    got = htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {f"Text {i} here" for i in range(8)}


def test_classes_nest():
    classes = [{"first": 0, "last": 100, "pages": 9}, {"first": 10, "last": 50, "pages": 9}, {"first": 20, "last": 30, "pages": 5}]
    assert htmltext.nest(classes) == [-1, 0, 1]


# ----------------------------------------------------------- 2 embeddings


def test_vectors(spark):
    nan = float("nan")
    base = [1.0] + [0.0] * 15
    near = [0.95, 0.31] + [0.0] * 14
    far = [0.0, 1.0] + [0.0] * 14
    rows = [(1, base), (2, [2 * x for x in base]), (3, near), (4, far), (5, None), (6, [0.0] * 16), (7, [nan] + [0.0] * 15), (8, [None] + [1.0] * 15), (9, []), (1, base), (10, [1.0, 0.0, 0.0]), (11, base)]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = capfilter.near_vectors(df).collect()
    assert len(got) == len(rows)
    r = {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in got}
    assert r[1] == (3, 1, True) and r[2] == (3, 1, False) and r[3] == (3, 1, False) and r[11] == (3, 1, False)
    for i in (4, 5, 6, 7, 8, 9, 10):
        assert r[i] == (0, i, True)
    assert capfilter.near_vectors(df.limit(0)).count() == 0


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n = rng.standard_normal((400, 64))
    n -= (n * x).sum(1, keepdims=True) * x
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    y = 0.9001 * x + np.sqrt(1 - 0.9001**2) * n
    rows = [(i, v.tolist()) for i, v in enumerate(np.vstack([x, y]))]
    links = capfilter.similar_links(spark.createDataFrame(rows, "id long, v array<double>"), 0.9)
    assert links.count() >= 0.995 * 400


def test_directions_grow_with_the_vectors():
    assert [capfilter.words_for(n) for n in (0, 1000, 51_282, 1 << 20, 1 << 28)] == [16, 16, 31, 64, 256]
    rng = np.random.default_rng(8)
    x = rng.standard_normal((200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n = rng.standard_normal((200, 64))
    n -= (n * x).sum(1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * n / np.linalg.norm(n, axis=1, keepdims=True)
    met = np.zeros(200, bool)
    for t in range(capfilter.TABLES):
        codes = capfilter.Codes(64, t, capfilter.words_for(1 << 24))
        for k in range(200):
            a, b = (capfilter.decode(*(h[0] for h in codes.halves(v[k : k + 1]))) for v in (x, y))
            assert len(a) >= capfilter.LEAST_HITS and a.max() < codes.words.shape[1] ** capfilter.BLOCKS
            met[k] |= len(np.intersect1d(a, b)) > 0
    assert met.mean() >= 0.98


def test_links_equal_brute_force_with_shared_ids(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((12, 24))
    v = base[rng.integers(0, 12, 240)] + rng.choice([0.05, 0.3, 0.5], (240, 1)) * rng.standard_normal((240, 24))
    v[200:210] = v[0]
    ids = [i // 2 if i < 60 else i for i in range(240)]  # two vectors an id
    rows = [(i, x.tolist()) for i, x in zip(ids, v, strict=True)]
    got = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in capfilter.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    reach = near.copy()
    for _ in range(10):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    want = Counter()
    for k in range(240):
        c = min(ids[m] for m in np.flatnonzero(reach[k]))
        want[ids[k], int(near[k].sum()) - 1, c, c == ids[k]] += 1
    assert got == want


def test_hot_filter_is_tiled(spark, monkeypatch):
    monkeypatch.setattr(capfilter, "TILE", 16)
    rng = np.random.default_rng(6)
    base = rng.standard_normal(32)
    rows = [(i, (base + 0.02 * rng.standard_normal(32)).tolist()) for i in range(100)]
    got = capfilter.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["n_links"] for r in got} == {99} and {r["component_id"] for r in got} == {0}


# ----------------------------------------------------------------- 3 chat


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*chat.CONTROLS, "\\", "x", "\n", "<", "[", "é", "|>"]), max_size=12).map("".join))
def test_escape_is_reversible(text):
    import re

    escaped = re.sub(rf"<({chat._ANGLE})", r"<\\\1", text.replace("\\", "\\\\"))
    escaped = re.sub(rf"\[({chat._SQUARE})", r"[\\\1", escaped)
    assert chat.unescape(escaped) == text and not any(c in escaped for c in chat.CONTROLS)


def test_escape_in_spark_is_the_same(spark):
    texts = ["</s>[INST] ok [/INST]", "\\<s>", "<|turn|><|text|>\\", "", "[[INST]]", "<<SYS>>x<</SYS>>"]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e")).collect():
        assert chat.unescape(r["e"]) == r["t"] and not any(c in r["e"] for c in chat.CONTROLS)


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, None, None, None), (None, 0, "user", "x"), (3, 5, "assistant", "y" * 200_000)]
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r for r in chat.read_back(chat.render(chat.canonical_turns(df))).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 5
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\na\nuser\na\nassistant\nb</s>\n").hexdigest()
    assert got[2]["turns_sha256"] == hashlib.sha256(b"\n\n").hexdigest() and got[2]["loss_sha256"] == EMPTY
    assert got[3]["loss_chars"] == 200_000 and got[None]["n_turns"] == 1
    assert chat.read_back(chat.render(chat.canonical_turns(df.limit(0)))).count() == 0


def test_layouts_become_turns(spark):
    records = [
        '{"messages": [{"role": "human", "content": "q"}, {"role": "assistant", "content": "a"}]}',
        '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "extra": 1}',
        '{"instruction": "q", "input": "", "output": "a"}',
        '{"prompt": "q", "completion": "a", "segment": 3}',
        '{"question": "q", "answer": "a"}',
        '{"something": "else"}',
    ]
    df = spark.createDataFrame(list(enumerate(records)), "conv_id long, j string")
    got = chat.json_turns(df, "j").collect()
    for k in range(5):
        assert sorted((r["turn"], r["role"], r["text"]) for r in got if r["conv_id"] == k) == [(0, "user", "q"), (1, "assistant", "a")]
    assert [r["conv_id"] for r in chat.unmatched_records(df, "j").collect()] == [5]
    nested = spark.createDataFrame([(7, [("user", "q")])], "conv_id long, messages array<struct<role:string,content:string>>")
    assert chat.canonical_turns(nested).first()[:] == (7, 0, "user", "q")
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.range(1))


def test_assembled_loss_spans(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo[INST]")]
    r = chat.assemble(chat.render(chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).first()
    assert [chat.unescape(r["formatted"][s["start"] : s["end"]]) for s in r["loss_spans"]] == ["yo[INST]"]


# -------------------------------------------------------------- 4 secrets


def test_secrets(spark):
    key = "AKIA" + "ABCDEFGHIJ1234"
    rows = [(1, f'é password = "Ab3dEf6hIj9k" {key}', "en", "s1", 0), (2, None, "en", "s1", 0), (3, "", None, None, 0), (4, "token=password:abcdefghijkl TOKEN:1234", "en", "s1", 0), (1, f'é password = "Ab3dEf6hIj9k" {key}', "en", "s1", 0)]
    rows += [(10 + k, f"secret: {'deadbeef01' * 3}", "en", f"o{k}", 0) for k in range(4)]
    df = clashing(spark.createDataFrame(rows, DOCS))
    got = secrets.report(secrets.classify(secrets.scan(df))).collect()
    assert len(got) == len(rows)
    r = {x["doc_id"]: x for x in got}
    assert r[1]["spans"] == "assign:2:26,live:14:26,access:28:46,live:28:46"
    assert r[2]["base_sha256"] == r[3]["base_sha256"] == EMPTY and r[2]["spans"] == ""
    assert r[4]["n_assign"] == 0  # a failing match uses its characters up
    assert r[10]["n_hex"] == 1 and r[10]["n_copied"] >= 1 and "live" not in r[10]["spans"]
    assert secrets.report(secrets.classify(secrets.scan(df.limit(0)))).count() == 0


def test_owners_and_repositories_decide(spark):
    value = "Ab3dEf6hIj9kLm"
    rows = [(k, f"token={value}", "own", f"own/r{k}") for k in range(50)] + [(100 + k, "token=Zz3dEf6hIj9kLm", "own", f"own/r{k}") for k in range(2)]
    rows += [(200 + k, "token=Qq3dEf6hIj9kLm", f"o{k}", f"o{k}/r") for k in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, repo string")
    r = {x["doc_id"]: x for x in secrets.report(secrets.classify(secrets.scan(df, repo_col="repo"))).collect()}
    assert r[7]["n_live"] == 0 and r[7]["n_copied"] == 1  # fifty repositories of one owner: an example
    assert r[100]["n_live"] == 1 and r[100]["n_copied"] == 0
    assert r[200]["n_live"] == r[200]["n_copied"] == 0  # two owners: neither


def test_redaction(spark):
    rows = [(1, 'x password = "Ab3dEf6hIj9k" y', "en", "s1", 0), (2, "clean", "en", "s1", 5), (3, None, "en", "s1", None)] + [(10 + k, "secret: " + "deadbeef01" * 3, "en", f"o{k}", 0) for k in range(4)]
    df = spark.createDataFrame(rows, DOCS).withColumn("_cuts", F.lit("mine"))
    got = {r["doc_id"]: r for r in secrets.redact(df).collect()}
    assert got[1]["text"] == 'x password = "[SECRET]" y' and got[1]["n_chars"] == len(got[1]["text"]) and got[1]["_cuts"] == "mine"
    assert got[2]["text"] == "clean" and got[3]["text"] is None and got[11]["text"].endswith("deadbeef01")


# --------------------------------------------------------- 5 suffix array


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", min_size=12, max_size=70), min_size=1, max_size=6))
def test_two_stage_sorting_finds_all_repeats(pieces):
    data = [p.encode() for p in pieces]
    got = suffix.repeats(np.arange(len(data)), np.zeros(len(data), int), data, 12)
    seen, expected = set(), []
    for d, b in enumerate(data):
        for s in range(len(b) - 11):
            if b[s : s + 12] in seen:
                expected.append((d, s))
            seen.add(b[s : s + 12])
    assert sorted(zip(got[0].tolist(), got[1].tolist(), strict=True)) == expected


def test_suffix_order_is_the_sorted_order():
    rng = np.random.default_rng(0)
    raw = bytes(rng.integers(97, 100, 500).astype(np.uint8))
    data = np.frombuffer(raw + bytes(104), np.uint8)
    order = suffix.two_stage_order(data, np.arange(500), 104)
    assert order.tolist() == sorted(range(500), key=lambda i: raw[i : i + 104])


def brute_repeats(texts, length=100):
    seen, out = set(), {}
    for doc, t in sorted(texts.items(), key=lambda x: (x[0] is not None, x[0] or 0)):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            g = b[s : s + length]
            if g in seen:
                gone[s : s + length] = True
            seen.add(g)
        out[doc] = (len(b), int(gone.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_repeats_in_documents(spark, monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK", 3000)
    monkeypatch.setattr(suffix, "MANY", 4)
    line = "the very common line that a lot of documents hold, with é and some more words until it is long enough, yes. " * 1
    texts = {i: words(60, i) + line[: 60 + 4 * (i % 20)] + words(40, 100 + i) for i in range(30)}
    texts |= {30: texts[3], 31: texts[3][200:] + texts[4], 32: None, 33: "", 34: "a" * 700, 35: "ab" * 400, 36: words(3000, 7) + words(3000, 7), None: texts[5]}
    rows = [*texts.items(), (3, texts[3])]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = suffix.remove_repeats(df).collect()
    assert len(got) == len(rows)
    expected = brute_repeats(texts)
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["kept_sha256"]) == expected[r["doc_id"]], r["doc_id"]
    assert suffix.remove_repeats(df.limit(0)).count() == 0


def test_repeats_where_an_id_has_two_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix, "CHUNK", 2000)
    monkeypatch.setattr(suffix, "MANY", 3)
    shared = words(60, 1)
    texts = [(7, "one " + shared), (7, "two " + shared + " end"), (7, "three"), (None, shared[:150]), (None, "x" + shared[10:200]), (9, shared), (9, shared), (4, "y" + shared[50:])]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    keyed = {(r["doc_id"], r["text"]): r["k"] for r in df.withColumn("k", F.xxhash64("text")).collect()}
    order = sorted(set(texts), key=lambda x: (x[0] is not None, x[0] or 0, keyed[x]))
    expected = brute_repeats(dict(enumerate(t for _, t in order)))
    want = sorted((str(order[i][0]), *v) for i, v in expected.items() for _ in range(texts.count(order[i])))
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in suffix.remove_repeats(df).collect())
    assert got == want


@pytest.mark.parametrize("many", [1, 3, 1000])
def test_collapsing_does_not_depend_on_batches(many, monkeypatch):
    monkeypatch.setattr(suffix, "MANY", many)
    r = random.Random(8)
    rows = sorted((r.randrange(6), r.randrange(8), r.randrange(3), r.randrange(2), r.randrange(4) << 16 | 5 << 1) for _ in range(300))
    table = suffix.pa.table([[x[k] for x in rows] for k in range(5)], names=["gram", "digest", "doc", "part", "place"])
    got = {}
    for size in (1, 2, 7, 50, 300):
        out = [tuple(x.values()) for b in suffix._collapse(iter(table.to_batches(max_chunksize=size))) for x in b.to_pylist()]
        got[size] = sorted(out)
    assert all(got[size] == got[300] for size in got)
    digests = {g: {x[1] for x in rows if x[0] == g} for g in range(6)}
    first = {(x[0], x[1]): min(y[2:] for y in rows if y[:2] == x[:2]) for x in rows}
    for g, found in digests.items():
        kinds = sorted(x[0] for x in got[300] if x[1] == g and x[0] != 1)
        assert kinds == ([] if len(found) == 1 else [2 if len(found) > many else 0] * len(found))
    assert sum(x[0] == 1 for x in got[300]) == sum(x[2:] != first[x[:2]] for x in rows)


# -------------------------------------------------------------- 7 quality


def test_quality(spark):
    good = "The quick report of the committee is that it was made for this and with the help of others in the end."
    rows = [(i, f"{good} {words(40, i, 300)}") for i in range(30)] + [(100 + i, " ".join(f"{w}%%%" for w in words(60, i).split())) for i in range(15)]
    rows += [(200, None), (201, ""), (202, "  \n "), (0, rows[0][1]), (203, "you stupid thing " + rows[1][1]), (204, rows[2][1] * 2000)]
    df = clashing(docs(spark, rows))
    labels = spark.createDataFrame([(0, 1, 0), (100, 0, 0), (100, 1, 0), (None, 1, None)], "doc_id long, quality int, toxic int")
    model = quality.train(df, labels)
    got = quality.classify(df, model).collect()
    assert len(got) == len(rows)
    r = {x["doc_id"]: x for x in got}
    assert all(r[i]["kept"] for i in range(30)) and not any(r[100 + i]["kept"] for i in range(15))
    assert not r[200]["kept"] and r[201]["score"] == 0 and r[203]["toxic"] and not r[203]["kept"]
    assert quality.filter_documents(df, labels).columns == df.columns
    empty = quality.train(df.limit(0), None)
    assert quality.classify(df.limit(0), empty).count() == 0


def test_expectation_maximisation_ranks_labellers():
    rng = np.random.default_rng(0)
    patterns = Counter()
    for _ in range(4000):
        truth = rng.random() < 0.8
        vote = [(truth if rng.random() < p else not truth) for p in (0.9, 0.6, 0.9, 0.95)]
        patterns["".join("+" if v else "-" for v in vote)] += 1
    posterior, accuracy = quality.weak_labels(dict(patterns), labellers=("a", "b", "c", "label"))
    a = list(accuracy.values())
    assert a[0] > a[1] and a[2] > a[1] and posterior["++++"] > 0.9 and posterior["----"] < 0.1


# --------------------------------------------------------------- 8 mixing


def test_mixing(spark):
    rows = [(i, words(5 + i % 40, i), "en", f"s{i % 4}" if i % 5 else None, 0) for i in range(400)] + [(1000, None, "en", "s1", 0), (1001, "", "en", "only", 0), (1002, "one", "en", "tiny", 0), (3, rows3 := words(8, 3), "en", "s3", 0)]
    df = clashing(spark.createDataFrame(rows, DOCS))
    got = mixing.mix(df).toPandas()
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all() and rows3
    by = got.groupby(got.source.fillna("~null")).agg(size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert by.target.sum() == pytest.approx(got["size"].sum())
    assert (abs(by.taken - by.target) <= 45).all() and by.target["only"] == 0 and by.target["tiny"] <= 3
    again = mixing.mix(df.repartition(7)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(got[key].itertuples(index=False, name=None)) == sorted(again[key].itertuples(index=False, name=None))
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix(df.filter("size(split(text, ' ')) = 0 or text is null")).toPandas().taken.sum() == 0


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_copies_are_next_to_the_rate(spark, scale):
    got = mixing.mix(common.table(spark, f"/root/testdata/{scale}", "documents")).toPandas()
    some = got[got["size"] > 0]
    rate = (some.target / some.source_size).clip(upper=3)
    assert ((some.copies >= np.floor(rate + 1e-12)) & (some.copies <= np.ceil(rate - 1e-12))).all()
    by = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert (abs(by.taken - by.target) <= 0.02 * by.target + 200).all()


def test_equal_rows_share_no_leaf(spark, monkeypatch):
    rows = [(None, "the same words", "en", "a", 0)] * 3000 + [(5, "other words here", "en", "b", 0)] * 3000 + [(5, None, "en", None, 0)]
    df = spark.createDataFrame(rows, DOCS)
    most = []
    level = mixing._level
    monkeypatch.setattr(mixing, "_level", lambda items, seed: most.append(items.groupBy("source", "leaf").count().agg(F.max("count")).first()[0]) or level(items, seed))
    got = mixing.mix(df, weights=(3, 2)).toPandas()
    assert max(most) < 4 * mixing.LEAF and len(got) == len(rows)
    by = got[got["size"] > 0].groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert (abs(by.taken - by.target) <= 3).all()


def test_duels_keep_expected_copies(spark):
    rows = [(i, words(10 + i % 7, i), "en", "a" if i % 2 else "b", 0) for i in range(60)]
    df = spark.createDataFrame(rows, DOCS).repartition(2).persist()
    total = Counter()
    for seed in range(12):
        for r in mixing.mix(df, weights=(3, 1), seed=seed).collect():
            total[r["doc_id"] % 2] += r["copies"]
    # source a comes first: 1.5 copies a document, b has 0.5
    assert total[1] / (30 * 12) == pytest.approx(1.5, abs=0.1) and total[0] / (30 * 12) == pytest.approx(0.5, abs=0.1)


# -------------------------------------------------------- 9 decontamination


def test_decontamination(spark):
    item = words(14, 1)
    rows = [(1, words(30, 2) + " " + item.upper() + "!! " + words(9, 3)), (2, words(50, 4)), (3, None), (4, ""), (5, "short phrase"), (1, "other"), (6, "x " * 5000 + item), (7, item.replace(" ", " -- "))]
    bench = spark.createDataFrame([(10, item), (2, "Short Phrase"), (3, ""), (4, None), (None, words(12, 4)), (10, item)], "item_id long, text string").withColumn("doc_id", F.lit(5))
    got = decontam.digest(decontam.find(clashing(docs(spark, rows)), bench)).collect()
    assert len(got) == len(rows)
    r = {(x["doc_id"], x["n_words"]): x for x in got}
    assert (r[1, 53]["n_hit"], r[1, 53]["n_items"], r[1, 53]["contaminated"]) == (14, 1, True)
    assert r[1, 53]["items_sha256"] == hashlib.sha256(b"10").hexdigest()
    assert not r[2, 50]["contaminated"] or r[2, 50]["items_sha256"] == hashlib.sha256(b"null").hexdigest()
    assert r[3, 0]["n_hit"] == r[4, 0]["n_hit"] == 0 and r[3, 0]["items_sha256"] == EMPTY
    assert r[5, 2]["n_hit"] == 2 and r[1, 1]["n_hit"] == 0 and r[6, 5014]["n_hit"] == 14 and r[7, 14]["n_hit"] == 14
    blocks = decontam.digest(decontam.find(docs(spark, rows), bench, block=3)).collect()
    assert sorted(map(tuple, blocks)) == sorted(map(tuple, got))
    assert decontam.digest(decontam.find(docs(spark, rows).limit(0), bench)).count() == 0
    assert not any(x["contaminated"] for x in decontam.digest(decontam.find(docs(spark, rows), bench.limit(0))).collect())


def test_proximity(spark):
    d = docs(spark, [(1, "aa x bb y cc"), (2, "cc bb aa"), (3, "aa bb"), (4, "aa bb cc")])
    bench = spark.createDataFrame([(1, "aa bb cc")], "item_id long, text string")
    near = {r["doc_id"] for r in decontam.find(d, bench, slop=2).collect() if r["items"]}
    exact = {r["doc_id"] for r in decontam.find(d, bench).collect() if r["items"]}
    assert near == {1, 2, 4} and exact == {4}


@pytest.mark.parametrize("shard", [1, 7, 200_000])
def test_proximity_stays_inside_documents(spark, monkeypatch, shard):
    monkeypatch.setattr(decontam, "SHARD", shard)
    r = random.Random(2)
    texts = [(1, "x alpha beta"), (2, "gamma y"), (3, "gamma x alpha beta"), (None, "beta alpha q gamma"), (5, "alpha beta"), (5, "gamma")]
    texts += [(10 + i, " ".join(r.choice(["alpha", "beta", "gamma", "d", "e"]) for _ in range(r.randrange(9)))) for i in range(60)]
    items = {1: "alpha beta gamma", 2: "d d e", 3: "gamma"}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    d = docs(spark, texts).repartition(2)
    for slop in (0, 2):
        expected = []
        for i, t in texts:
            w, hit = t.split(), set()
            for item, phrase in items.items():
                p = phrase.split()
                for s in range(len(w)):
                    part = w[s : s + len(p) + slop]
                    if (w[s : s + len(p)] == p) if not slop else not Counter(p) - Counter(part):
                        hit.add(str(item))
            expected.append((str(i), t, sorted(hit)))
        keyed = {x["k"]: x["text"] for x in d.select("text", F.xxhash64("text").alias("k")).collect()}
        got = [(str(x["doc_id"]), keyed[x["text_key"]], x["items"]) for x in decontam.find(d, bench, slop=slop, block=2).collect()]
        assert sorted(got) == sorted(expected)


def test_blocks_share_one_index(spark, monkeypatch):
    built = []
    build = decontam.build_index
    monkeypatch.setattr(decontam, "build_index", lambda *a: built.append(1) or build(*a))
    bench = spark.createDataFrame([(1, words(40, 1))], "item_id long, text string")
    assert decontam.find(docs(spark, [(1, words(40, 1))]), bench, block=3).first()["items"] == ["1"]
    assert len(built) == 1


# -------------------------------------------------------------- 10 MinHash


def test_near_groups(spark):
    base = words(200, 1).split()
    edit = base[:100] + ["changed"] + base[101:]
    rows = [(5, " ".join(base)), (3, " ".join(edit)), (9, " ".join(base).upper()), (1, words(200, 2)), (20, None), (21, ""), (22, " \t\n"), (23, "two words"), (24, "TWO  words"), (25, "one"), (5, " ".join(base)), (30, words(60_000, 3)), (31, words(60_000, 3) + " end")]
    df = clashing(docs(spark, rows))
    got = minhash.near_groups(df).collect()
    assert len(got) == len(rows)
    r = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in got}
    assert r[5][1] == r[9][1] == r[3][1] == 3 and r[3][2] and not r[5][2]
    assert r[1][1] == 1 and r[23] == (1, 23, True) and r[24] == (1, 23, False) and r[25] == (1, 25, True)
    assert all(r[i] == (0, i, True) for i in (20, 21, 22))
    assert r[31][1] == 30
    assert minhash.near_groups(df.limit(0)).count() == 0


def test_dense_regions_keep_their_components(spark):
    base = words(300, 11).split()
    rows, r = [], random.Random(4)
    for i in range(300):
        w = list(base)
        for _ in range(r.randrange(0, 26)):
            w[r.randrange(300)] = f"n{r.random()}"
        rows.append((i, " ".join(w)))
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_groups(docs(spark, rows)).collect()}
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(298)} for i, t in rows}
    up = list(range(300))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(300):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    assert got == {i: find(i) for i in range(300)}


# ----------------------------------------------------------------- shared


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    up = {x: x for p in links for x in p}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {x["node"]: x["component_id"] for x in graph.components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    assert got == {x: find(x) for x in up if any(x in p and p[0] != p[1] for p in links)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_membership_filter_never_misses(spark):
    keys = spark.range(0, 3000, 3).toDF("k")
    df = spark.range(3000).toDF("k")
    kept = {x["k"] for x in common.prefilter(df, F.col("k"), keys).collect()}
    assert set(range(0, 3000, 3)) <= kept and len(kept) < 1200
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (None, "a"), (None, "b"), (2, "a"), (3, None)], "doc_id long, text string").withColumn("maybe", F.lit(1))
    gone = rows.filter("(doc_id = 1 and text = 'a') or (doc_id is null and text = 'b')").select("doc_id", F.xxhash64("text").alias("text_key"))
    left = sorted(common.without(rows, gone).select("doc_id", "text").collect(), key=str)
    assert [tuple(x) for x in left] == [(1, "b"), (2, "a"), (2, "a"), (3, None), (None, "a")]
    twice = rows.filter("doc_id = 2").select("doc_id", F.xxhash64("text").alias("text_key"))
    assert common.once(rows, twice).count() == 6 and common.once(rows, twice).columns == rows.columns


# ------------------------------------------------------------------ 6 WARC


def captures(spark, rows):
    return spark.createDataFrame(rows, warc.FIELDS)


def test_canonical_urls(spark):
    same = ["http://www.Example.com:80/a/?b=2&a=1#x", "https://example.com/a?a=1&b=2&utm_source=q", "//user@example.com/a/index.html?a=1&b=2&"]
    got = {r[0] for r in spark.createDataFrame([(u,) for u in same], "u string").select(warc.canonical_url(F.col("u"))).collect()}
    assert got == {"example.com/a?a=1&b=2"}
    assert spark.createDataFrame([(None,), ("",), ("x",)], "u string").select(warc.canonical_url(F.col("u"))).distinct().count() == 1


def test_revisits(spark):
    u = "http://h.example/p"
    rows = [
        (1, u, 10, "response", "d1", {"ETag": '"a"', "Content-Length": "5", "Date": "10", "Content-Type": "text/html"}),
        (2, u, 10, "revisit", None, {"etag": 'W/"a"', "Date": "11", "Content-Length": "0"}),
        (3, u, 5, "revisit", None, {"etag": '"a"'}),
        (4, u, 20, "response", "d2", {"ETag": '"b"', "Last-Modified": "m"}),
        (5, u + "#frag", 30, "revisit", None, {"ETag": '"a"'}),
        (6, u, 31, "revisit", None, {"Date": "31"}),
        (7, u, 32, "revisit", "d2", None),
        (8, u, 33, "revisit", None, {"Last-Modified": "m", "ETag": None}),
        (9, None, 40, "revisit", None, {"etag": '"a"'}),
        (10, None, None, "response", None, None),
        (5, u + "#frag", 30, "revisit", None, {"ETag": '"a"'}),
        (11, u, None, "revisit", None, {}),
    ]
    df = clashing(captures(spark, rows)).withColumn("part", F.lit(0))
    got = warc.resolve_revisits(df).collect()
    assert len(got) == len(rows)
    r = {x["record_id"]: x for x in got}
    assert r[2]["status"] == "resolved" and r[2]["response_id"] == 1 and r[2]["digest"] == "d1"
    assert r[2]["headers"] == {"etag": 'W/"a"', "date": "11", "content-length": "5", "content-type": "text/html"}
    assert (r[3]["status"], r[11]["status"], r[9]["status"]) == ("unresolved",) * 3
    assert (r[5]["status"], r[5]["response_id"]) == ("mismatch", 4)
    assert (r[6]["status"], r[7]["status"], r[8]["status"]) == ("unvalidated", "resolved", "resolved")
    assert r[1]["status"] == r[10]["status"] == "full"
    assert warc.resolve_revisits(df.limit(0)).count() == 0


def test_hot_url_over_many_partitions(spark):
    r = random.Random(3)
    rows = [(k, "http://hot.example/", r.randrange(10_000), "response" if r.random() < 0.01 else "revisit", "d", {}) for k in range(3000)]
    got = {x["record_id"]: x["response_id"] for x in warc.resolve_revisits(captures(spark, rows)).collect() if x["kind"] == "revisit"}
    responses = sorted((t, k) for k, _, t, kind, _, _ in rows if kind == "response")
    for k, _, t, kind, _, _ in rows:
        if kind == "revisit":
            before = [i for at, i in responses if at <= t]
            assert got[k] == (before[-1] if before else None)


def test_archive_files(spark, tmp_path):
    def record(kind, uri, http, extra=""):
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {uri}\r\nWARC-Date: 2024-01-01T00:00:0{len(http) % 10}Z\r\n{extra}Content-Length: {len(http)}\r\n\r\n{http}\r\n\r\n".encode()

    import gzip

    data = record("warcinfo", "", "software: x") + record("response", "http://a/", 'HTTP/1.1 200 OK\r\nETag: "x"\r\n\r\nbody') + record("revisit", "http://a/", 'HTTP/1.1 304 Not Modified\r\nETag: "x"\r\n\r\n')
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(data))
    got = warc.read_warc(spark, str(tmp_path)).collect()
    assert [(r["kind"], r["headers"]["etag"]) for r in got] == [("response", '"x"'), ("revisit", '"x"')] and bytes(got[0]["payload"]) == b"body"


def test_broken_archives():
    import gzip

    def record(uri, http, length=None):
        return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: {uri}\r\nContent-Length: {len(http) if length is None else length}\r\n\r\n{http}\r\n\r\n".encode()

    page = "HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody"
    uris = lambda data: [r["uri"] for r in warc.parse_warc(data)]
    assert uris(record("a", page) + record("b", page, "abc") + record("c", page)) == ["a", "c"]
    assert uris(record("a", page, "x")) == [] and uris(b"") == [] and uris(b"\x1f\x8bno") == []
    packed = gzip.compress(record("a", page)) + gzip.compress(record("b", page * 500))
    assert uris(packed) == ["a", "b"] and uris(packed[:-9])[:1] == ["a"]

"""Benchmark decontamination over a distributed positional inverted index.

1. The training corpus is scanned once and indexed whole. Documents are laid side by side in shards of about
   ``SHARD`` words, with a gap between them; a shard's row holds the documents' places and, for each distinct word,
   its posting list: the sorted places of the word in the shard. So a frequent word's postings are
   split over all shards, and no posting is ever shuffled.
2. Test items are cut into phrases: every window of ``window`` words (an item of
   fewer words is one phrase). Their distinct words are the terms; frequencies of the terms are
   the lengths of their posting lists, summed over all shards.
3. In each shard a phrase starts from its rarest term: that term's posting list, moved back by its
   offset in the phrase, holds the possible starts. They are intersected with the moved
   list of the next rarest term, and so on; what is left after all terms are
   the exact occurrences. ``slop`` > 0 asks for proximity matches instead: all words
   of the phrase inside ``window + slop`` words of one document, in any order.

Test phrases travel to executors in blocks of at most ``BLOCK`` phrases, so what is
broadcast has a fixed bound whatever the size of the test sets; all blocks share the index.

Defined results
* null or empty text: no words, nothing hit, not contaminated.
* item without words: matches nothing; null ``item_id``: written as ``null``.
* rows that repeat, of documents or items: each document row is judged by itself, whatever its id (null ids too);
  an item id counts once a document.
* a very long text is a shard of its own.
* empty documents: no rows; empty benchmark: no hits. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, keep

WINDOW = 10
#: Phrases in one broadcast block (about 60 MB at ten words).
BLOCK = 500_000
#: Words of a shard, unless one document has more, and possible starts looked at together.
SHARD, STARTS = 100_000, 500_000

#: One byte table lower-cases A-Z and blanks whatever is no word character.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Words of a text: runs of letters, digits and non-ASCII characters, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


# ----------------------------------------------------------------- test phrases


def phrases(items: list[tuple], window: int = WINDOW) -> list[tuple[str, tuple[bytes, ...]]]:
    """(item id as string, words) of every window of the items."""
    out = []
    for item, text in items:
        name, w = "null" if item is None else str(item), words(text)
        if w:
            out += [(name, tuple(w[i : i + window])) for i in range(max(1, len(w) - window + 1))]
    return out


class Block:
    """Distinct phrases of a block, as term numbers, with the items that hold them."""

    def __init__(self, found: list[tuple[str, tuple[bytes, ...]]]) -> None:
        self.items: dict[tuple[bytes, ...], list[str]] = {}
        for item, phrase in found:
            got = self.items.setdefault(phrase, [])
            if not got or got[-1] != item:
                got.append(item)
        self.phrases = list(self.items)
        self.terms = {w: i for i, w in enumerate(sorted({w for p in self.phrases for w in p}))}

    def plan(self, frequency: np.ndarray) -> dict:
        """Arrays the executors need: phrases grouped by their rarest term, terms in order of rarity."""
        width = max((len(p) for p in self.phrases), default=1)
        ids = np.full((len(self.phrases), width), -1, np.int32)
        for k, p in enumerate(self.phrases):
            ids[k, : len(p)] = [self.terms[w] for w in p]
        rarity = np.where(ids >= 0, frequency[np.maximum(ids, 0)], np.iinfo(np.int64).max)
        order = np.argsort(rarity, axis=1, kind="stable").astype(np.int32)
        ordered = np.take_along_axis(ids, order, axis=1)
        by = np.argsort(ordered[:, 0], kind="stable")
        first = ordered[by, 0]
        n = len(self.terms)
        return {"words": self.terms, "lengths": (ids >= 0).sum(1).astype(np.int64)[by], "offsets": order[by].astype(np.int64), "terms": ordered[by], "start": np.searchsorted(first, np.arange(n)), "stop": np.searchsorted(first, np.arange(n), side="right"), "names": [self.items[self.phrases[k]] for k in by]}


# -------------------------------------------------------------------- the index

_SHARD = "shard long, doc_id array<long>, text_key array<long>, begin array<int>, n_words array<int>, word array<binary>, stop array<int>, place array<int>"


class _Numbers(dict):
    """Numbers words by their first appearance."""

    def __missing__(self, word: bytes) -> int:
        got = self[word] = len(self)
        return got


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, made = TaskContext.get().partitionId() if TaskContext.get() else 0, 0
    ids, keys, counts, held = [], [], [], []

    def shard() -> pa.RecordBatch:
        nonlocal made
        n_words = np.array(counts, np.int32)
        begin = np.cumsum(n_words + 1) - n_words - 1  # a gap after each document
        number = _Numbers()
        term = np.fromiter(map(number.__getitem__, held), np.int32, len(held))
        place = np.arange(len(held), dtype=np.int32) + np.repeat(np.arange(len(n_words), dtype=np.int32), n_words)
        order = np.argsort(term, kind="stable")
        stop = np.cumsum(np.bincount(term, minlength=len(number))).astype(np.int32)
        columns = ((ids, pa.int64()), (keys, pa.int64()), (begin.astype(np.int32), pa.int32()), (n_words, pa.int32()), (list(number), pa.binary()), (stop, pa.int32()), (place[order], pa.int32()))
        lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c, kind)) for c, kind in columns]
        row = pa.RecordBatch.from_arrays([pa.array([part << 33 | made], pa.int64()), *lists], names=[x.split()[0] for x in _SHARD.split(", ")])
        made += 1
        for x in (ids, keys, counts, held):
            x.clear()
        return row

    for batch in batches:
        for doc, text, key in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            w = words(text.as_py())
            if held and len(held) + len(w) > SHARD:
                yield shard()
            ids.append(doc)
            keys.append(key)
            counts.append(len(w))
            held += w
    if ids:
        yield shard()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each shard: its documents' ids, text hashes, begins and sizes; its words, where each word's list stops, and the lists."""
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col), F.xxhash64(text_col))
    return keep(rows.mapInArrow(_inverted, _SHARD), "index", texts=True)


def _list(column: pa.Array, k: int) -> np.ndarray:
    return column[k].values.to_numpy(zero_copy_only=False)


def _held_terms(terms: dict[bytes, int], word: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(number in the shard, term) of the shard's words that are terms."""
    got = np.fromiter((terms.get(w, -1) for w in word.to_pylist()), np.int64, len(word))
    at = np.flatnonzero(got >= 0)
    return at, got[at]


def _count_terms(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                at, term = _held_terms(terms, batch.column(0)[k].values)
                total[term] += np.diff(_list(batch.column(1), k), prepend=0)[at]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["term", "n"])

    return run


def frequencies(index: DataFrame, terms: dict[bytes, int]) -> np.ndarray:
    """How often each term occurs in the corpus: the lengths of its lists. The number of terms is bounded by the block."""
    out = np.zeros(max(len(terms), 1), np.int64)
    if terms:
        shared = index.sparkSession.sparkContext.broadcast(terms)
        counted = keep(index.select("word", "stop").mapInArrow(_count_terms(shared), "term int, n long"), "terms", texts=True)
        got = counted.groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        drop(counted)
        out[got["term"].to_numpy()] = got["n"].to_numpy()
    return out


# -------------------------------------------------------------------- matching


class Postings:
    """Lists of the terms that a shard holds, as one sorted array of (term, place)."""

    def __init__(self, term: np.ndarray, size: np.ndarray, places: list[np.ndarray]) -> None:
        order = np.argsort(term, kind="stable")
        self.term, self.size = term[order], size[order]
        self.begin = np.cumsum(self.size) - self.size
        self.place = np.concatenate([places[i] for i in order]).astype(np.int64) if len(order) else np.zeros(0, np.int64)
        self.key = np.repeat(self.term, self.size) << 32 | self.place

    def holds(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether each place is in the list of its term."""
        if not len(self.key):
            return np.zeros(len(term), bool)
        want = term << 32 | place
        at = np.searchsorted(self.key, want)
        return self.key[np.minimum(at, len(self.key) - 1)] == want

    def list(self, term: int) -> np.ndarray:
        i = int(np.searchsorted(self.term, term))
        return self.place[self.begin[i] : self.begin[i] + self.size[i]] if i < len(self.term) and self.term[i] == term else self.place[:0]


def _present(lists: Postings, plan: dict) -> tuple[np.ndarray, np.ndarray]:
    """(place of the rarest term among the shard's terms, phrase) of the phrases whose terms the shard has all."""
    n = plan["stop"][lists.term] - plan["start"][lists.term]
    of = np.repeat(np.arange(len(n)), n)
    phrase = np.repeat(plan["start"][lists.term], n) + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    here = np.zeros(len(plan["start"]) + 1, bool)  # the last one stands for "no term" in shorter phrases
    here[lists.term] = here[-1] = True
    fine = here[plan["terms"][phrase]].all(axis=1)
    return of[fine], phrase[fine]


def exact_starts(lists: Postings, plan: dict) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, start) of every occurrence in a shard."""
    of, phrases = _present(lists, plan)
    size = lists.size[of]
    # A frequent term has many possible starts: they are looked at piece by piece.
    cuts = np.r_[np.flatnonzero(np.diff((np.cumsum(size) - size) // STARTS, prepend=-1)), len(size)]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        m = size[i:j]
        at = np.repeat(lists.begin[of[i:j]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        phrase = np.repeat(phrases[i:j], m)
        start = lists.place[at] - plan["offsets"][phrase, 0]
        phrase, start = phrase[start >= 0], start[start >= 0]
        for k in range(1, plan["terms"].shape[1]):
            need = plan["terms"][phrase, k].astype(np.int64)
            same = need < 0
            rest = np.flatnonzero(~same)
            same[rest] = lists.holds(need[rest], start[rest] + plan["offsets"][phrase[rest], k])
            phrase, start = phrase[same], start[same]
        found.append((phrase, start))
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def near_spans(lists: Postings, plan: dict, slop: int, begin: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, start, end) of windows of phrase length + slop words, inside one document, that hold all its words.

    The rarest term's list gives the candidates: for each of its places the first window around it that holds
    every word as often as the phrase does, counted in the words' lists.
    """
    out = []
    for of, phrase in zip(*(x.tolist() for x in _present(lists, plan)), strict=True):
        length = int(plan["lengths"][phrase])
        need: dict[int, int] = {}
        for x in plan["terms"][phrase, :length].tolist():
            need[x] = need.get(x, 0) + 1
        words_at = [(lists.list(x), c) for x, c in need.items()]
        for at in lists.list(int(lists.term[of])).tolist():
            doc = int(np.searchsorted(begin, at, side="right")) - 1
            low, high = int(begin[doc]), int(begin[doc] + n_words[doc])
            for start in range(max(low, at - length - slop + 1), at + 1):
                end = min(start + length + slop, high)
                if all(np.searchsorted(w, end) - np.searchsorted(w, start) >= c for w, c in words_at):
                    out.append((phrase, start, end))
                    break
    got = np.array(out, np.int64).reshape(-1, 3)
    return got[:, 0], got[:, 1], got[:, 2]


_HITS = "shard long, doc int, starts array<int>, ends array<int>, items array<string>"


def _match(shared, slop: int):
    """Hits of a block's phrases: a row for each document that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                begin, n_words = _list(batch.column(1), k).astype(np.int64), _list(batch.column(2), k).astype(np.int64)
                stop, place = _list(batch.column(4), k), _list(batch.column(5), k)
                at, term = _held_terms(plan["words"], batch.column(3)[k].values)
                low = np.where(at > 0, stop[at - 1], 0)
                lists = Postings(term, (stop[at] - low).astype(np.int64), [place[a:b] for a, b in zip(low.tolist(), stop[at].tolist(), strict=True)])
                if slop:
                    phrase, start, end = near_spans(lists, plan, slop, begin, n_words)
                else:
                    phrase, start = exact_starts(lists, plan)
                    end = start + plan["lengths"][phrase]
                doc = np.searchsorted(begin, start, side="right") - 1
                hit: dict[int, list] = {}
                for d, p, s, e in zip(doc.tolist(), phrase.tolist(), (start - begin[doc]).tolist(), (end - begin[doc]).tolist(), strict=True):
                    hit.setdefault(d, []).append((s, e, p))
                rows = [(batch.column(0)[k].as_py(), d, [x[0] for x in spans], [x[1] for x in spans], sorted({i for x in spans for i in plan["names"][x[2]]})) for d, spans in hit.items()]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], names=["shard", "doc", "starts", "ends", "items"])

    return run


def _blocks(bench: DataFrame, id_col: str, text_col: str, window: int, block: int) -> Iterator[list]:
    """Phrases in bounded blocks; items stream to the driver one partition at a time."""
    held: list = []
    for row in bench.select(id_col, text_col).toLocalIterator():
        for p in phrases([tuple(row)], window):
            held.append(p)
            if len(held) >= block:
                yield held
                held = []
    yield held


def find(docs: DataFrame, bench: DataFrame, window: int = WINDOW, slop: int = 0, block: int = BLOCK) -> DataFrame:
    """doc_id, text_key, n_words, starts, ends (word spans), items: the occurrences of test phrases, a row for each document."""
    spark = docs.sparkSession
    index = build_index(docs)
    hits = []
    for found in _blocks(bench, "item_id", "text", window, block):
        made = Block(found)
        if not made.phrases:
            continue
        plan = spark.sparkContext.broadcast(made.plan(frequencies(index, made.terms)))
        hits.append(keep(index.select("shard", "begin", "n_words", "word", "stop", "place").mapInArrow(_match(plan, slop), _HITS), "hits", texts=True))
        plan.unpersist()
    each = index.select("shard", F.posexplode(F.arrays_zip("doc_id", "text_key", "n_words")).alias("doc", "d")).select("shard", "doc", "d.*")
    documents = keep(each.select("shard", "doc", "doc_id", "text_key", F.col("n_words").cast("long").alias("n_words")), "indexed")
    drop(index)
    if not hits:
        return documents.select("doc_id", "text_key", "n_words", F.array().cast("array<int>").alias("starts"), F.array().cast("array<int>").alias("ends"), F.array().cast("array<string>").alias("items"))
    every = hits[0]
    for more in hits[1:]:
        every = every.unionByName(more)
    if len(hits) > 1:
        lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items")]
        every = every.groupBy("shard", "doc").agg(*lists).withColumn("items", F.array_sort(F.array_distinct("items")))
    met = documents.join(every, ["shard", "doc"], "left")
    empty = {"starts": "array<int>", "ends": "array<int>", "items": "array<string>"}
    return met.select("doc_id", "text_key", "n_words", *[F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in empty.items()])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, _, n_words, starts, ends, items = (c.to_pylist() for c in batch.columns)
        n_hit, digests = [], []
        for n, s, e, names in zip(n_words, starts, ends, items, strict=True):
            cover = np.zeros(n + 1, np.int32)
            np.add.at(cover, np.array(s, np.int64), 1)
            np.add.at(cover, np.array(e, np.int64), -1)
            n_hit.append(int((np.cumsum(cover)[:n] > 0).sum()) if s else 0)
            digests.append(hashlib.sha256(",".join(sorted(names)).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digests, pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_())],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def digest(found: DataFrame) -> DataFrame:
    """The counts and digests of ``find``'s spans."""
    return found.mapInArrow(_digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")

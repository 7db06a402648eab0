"""Repeated byte strings by two-stage suffix sorting.

A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a
document with a smaller id, or earlier in the same one.

1. Anchors. Every string of ``length`` bytes is assigned to the leftmost of its 32-byte
   grams with the least hash, so equal strings have equal anchors at equal places.
   Neighbouring strings with one anchor form a stretch; a stretch is a row of fixed size.
2. Equal stretches collapse to the first one, by a digest of anchor and bytes; later ones
   are repeats as a whole. Stretches whose anchor nobody shares cannot repeat.
3. What is left, stretches that share an anchor but differ, is where copies begin and
   end. Their suffixes are put in order by two-stage sorting: suffixes smaller than their successors are
   sorted directly, all others are induced by scanning the buckets of first bytes, and
   prefixes common to neighbours in that order show which strings are equal.
4. An anchor with more than ``MANY`` different stretches is dealt by longer grams that
   hold most of the string, so its stretches spread over tasks. Whether it has is known while its stretches
   stream by, sorted, so no second look at hot anchors is needed.

Suffixes of different tasks share no anchor, hence no string. Texts never meet in
one place: a task sorts chunks of a few MB.

Defined results
* null or empty text: nothing removed, the digest of no bytes. Texts below ``length`` bytes stay whole.
* a document is an id and a text. Rows that repeat as a whole are one document, not a repeat of itself; each
  gets the same result. Rows that share an id but not a text are documents in the order of their texts' hashes.
* null id: before every other document. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, keep, may_hold, prefilter
from .minhash import mix64

LENGTH = 100
GRAM = 32
#: Bytes that are hashed together, and bytes of stretches that are sorted together.
CHUNK, SORTED = 1 << 19, 1 << 20
#: Different stretches of one anchor beyond which they are dealt by longer grams, and starts in a part then.
MANY, PART = 256, 8
_FIRST = -(1 << 63)

_rng = np.random.default_rng(5)
_TABLES = _rng.integers(0, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15 | 5, 0xC2B2AE3D27D4EB4F | 5)


_POWERS: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if (which, n) in _POWERS:
        return _POWERS[which, n]
    if len(_POWERS) >= 4:
        _POWERS.clear()
    base = _BASES[which]
    up = np.full(n, np.uint64(base))
    down = np.full(n, np.uint64(pow(base, -1, 1 << 64)))
    up[0] = down[0] = 1
    _POWERS[which, n] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[which, n]


class Hashes:
    """Hashes of any substring of a buffer, mod 2 ** 64, mixed."""

    def __init__(self, data: np.ndarray, which: int) -> None:
        n = 1 << max(12, int(len(data) + 1).bit_length())
        self.up, self.down = _powers(which, n)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLES[which][data] * self.up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix64((self.sums[size:] - self.sums[:n]) * self.down[:n])


def _sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    out, span = key, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def stretches(data: np.ndarray, begin: np.ndarray, count: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Stretches of texts in one buffer. begin, count: where a text begins and how many strings start in it.

    Returns text, start in the buffer, number of strings, anchor hash, digest of the bytes.
    """
    empty = np.zeros(0, np.int64)
    if len(data) < length or not count.any():
        return empty, empty, empty, empty, empty
    first = Hashes(data, 0)
    grams = first.grams(gram)
    place = np.arange(len(grams), dtype=np.uint64)
    least = _sliding_least((grams & np.uint64(0xFFFFFFFF00000000)) | place, length - gram + 1)
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(begin)), count)
    start = np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    anchor = anchor[start]
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    size = np.diff(np.r_[new, len(start)])
    s, a = start[new], anchor[new]
    shape = mix64(((a - s).astype(np.uint64) << np.uint64(32)) | size.astype(np.uint64))
    digest = Hashes(data, 1).of(s, s + size + length - 1) ^ shape
    return text[new], s, size, grams[a].view(np.int64), digest.view(np.int64)


def _pieces(ids: list, keys: list, texts: pa.Array, length: int) -> Iterator[tuple]:
    """Buffers of about CHUNK bytes: data, documents (id, text hash), begins in the buffer, places in the document, strings.

    A longer text comes in pieces that overlap by length - 1 bytes.
    """
    parts, docs, hashes, begin, place, count, size = [], [], [], [], [], [], 0

    def done() -> tuple:
        return np.frombuffer(b"".join(parts), np.uint8), *(np.array(x, np.int64) for x in (docs, hashes, begin, place, count))

    for k, doc in enumerate(ids):
        text = texts[k].as_py()
        data = text.encode("utf-8", "surrogatepass") if text else b""
        for at in range(0, len(data) - length + 1, CHUNK):
            piece = data[at : at + CHUNK + length - 1]
            parts.append(piece)
            docs.append(doc)
            hashes.append(keys[k])
            begin.append(size)
            place.append(at)
            count.append(min(CHUNK, len(data) - length + 1 - at))
            size += len(piece)
            if size >= CHUNK:
                yield done()
                parts, docs, hashes, begin, place, count, size = [], [], [], [], [], [], 0
    if parts:
        yield done()


# A shuffled row is five longs; place: start, size (below 2 ** 15) and whether the stretch is a known repeat.
_PACKED = "gram long, digest long, doc long, part long, place long"
# kind 0: a stretch that was first here, of an anchor with several; kind 1: a run of starts that are repeats; kind 2: as 0, of an anchor with many.
_ROW = "kind int, gram long, doc long, part long, start int, size int"


def _rows(kind: int, gram, doc, part, start, size) -> pa.RecordBatch:
    n = len(doc)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(gram), pa.array(doc), pa.array(part), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))], names=["kind", "gram", "doc", "part", "start", "size"])


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, docs, hashes, begin, place, count in _pieces(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), length):
                text, s, size, gram, digest = stretches(data, begin, count, length)
                doc, part, start = docs[text], hashes[text], s - begin[text] + place[text]
                order = np.lexsort((start, part, doc, digest, gram))
                gram, digest, doc, part, start, size = (x[order] for x in (gram, digest, doc, part, start, size))
                new = np.r_[True, (gram[1:] != gram[:-1]) | (digest[1:] != digest[:-1])] if len(gram) else np.zeros(0, bool)
                lead = np.flatnonzero(new)[np.cumsum(new) - 1]
                again = ~new & ((doc != doc[lead]) | (part != part[lead]) | (start != start[lead]))
                kept = new | again
                packed = (start << 16) | (size << 1) | again
                yield pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in (gram, digest, doc, part, packed)], names=["gram", "digest", "doc", "part", "place"])

    return run


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by gram, digest, document, start: repeats, and first stretches of anchors that have several.

    Carried on: the first row of the running digest, and up to MANY first stretches of the running anchor.
    """
    lead: list[np.ndarray] | None = None
    held: list[list[np.ndarray]] = []  # they wait for the anchor to have several, or many
    seen, many = 0, False

    def close() -> Iterator[pa.RecordBatch]:
        if held and seen > 1:
            yield _rows(0, *[np.concatenate(c) for c in zip(*held, strict=True)])
        held.clear()

    for batch in batches:
        gram, digest, doc, part, place = (batch.column(k).to_numpy() for k in range(5))
        start, size, passed = place >> 16, (place & 0xFFFF) >> 1, (place & 1) == 1
        if passed.any():
            yield _rows(1, gram[passed], doc[passed], part[passed], start[passed], size[passed])
        cols = [x[~passed] for x in (gram, digest, doc, part, start, size)]
        if not len(cols[0]):
            continue
        carried = lead is not None
        if carried:
            cols = [np.concatenate(x) for x in zip(lead, cols, strict=True)]
        gram, digest, doc, part, start, size = cols
        new = np.r_[True, (gram[1:] != gram[:-1]) | (digest[1:] != digest[:-1])]
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        again = ~new & ((doc != doc[first]) | (part != part[first]) | (start != start[first]))
        if again.any():
            yield _rows(1, gram[again], doc[again], part[again], start[again], size[again])
        new[0] = not carried
        rows = np.flatnonzero(new)
        edges = np.flatnonzero(np.r_[True, gram[rows][1:] != gram[rows][:-1]]) if len(rows) else rows
        ends = np.r_[edges[1:], len(rows)]
        if carried and len(rows) and gram[rows[0]] != gram[0]:  # the running anchor is over
            yield from close()
            seen, many = 0, False
        for k in (0, len(edges) - 1):  # the anchor that runs on from before, and the one that may go on
            if not len(edges) or (k == 0 and len(edges) > 1 and not (carried and gram[rows[0]] == gram[0])):
                continue
            if k:
                yield from close()
                seen, many = 0, False
            own = [x[rows[edges[k] : ends[k]]] for x in (gram, doc, part, start, size)]
            seen += len(own[0])
            held.append(own)
            if seen > MANY:
                many = True
            if many:
                yield _rows(2, *[np.concatenate(c) for c in zip(*held, strict=True)])
                held.clear()
            if len(edges) == 1:
                break
        begin = 1 if carried and len(rows) and gram[rows[0]] == gram[0] else 0
        if len(edges) > 1:  # anchors that lie in this batch as a whole
            sizes = (ends - edges)[begin:-1]
            of = np.repeat(sizes, sizes)
            inside = rows[edges[begin] : edges[-1]]
            for kind, ok in ((0, (of > 1) & (of <= MANY)), (2, of > MANY)):
                if ok.any():
                    yield _rows(kind, *[x[inside[ok]] for x in (gram, doc, part, start, size)])
        lead = [x[first[-1:]] for x in cols]
    yield from close()


def _cut(length: int):
    """Bytes of the stretches of each text; those of crowded anchors in parts with a longer gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[]] * 5
            got = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["key", "doc", "part", "start", "data"])
            out.clear()
            return got

        for batch in batches:
            for doc, part, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                for f in found.as_py():
                    s, n = f["start"], f["size"]
                    if not f["many"]:
                        out.append((f["gram"], doc, part, s, data[s : s + n + length - 1]))
                    else:
                        for lo, hi, core in _parts(data, s, n, f["gram"], length):
                            out.append((core, doc, part, lo, data[lo : hi + length]))
                    held += n + length
                    if held > CHUNK:
                        yield flush()
                        held = 0
        yield flush()

    return run


def _parts(data: bytes, start: int, size: int, gram: int, length: int) -> Iterator[tuple[int, int, int]]:
    """(first start, last start, hash of the bytes that all strings of the part hold), cut at the same places from the anchor."""
    view = np.frombuffer(data[start : start + size + length - 1], np.uint8)
    h = Hashes(view, 0)
    grams = h.grams(GRAM)
    anchor = int(np.flatnonzero(grams.view(np.int64) == gram)[0]) if (grams.view(np.int64) == gram).any() else 0
    for q in range((anchor - size + 1) // PART, anchor // PART + 1):  # starts whose distance to the anchor is in [q * PART, (q + 1) * PART)
        lo, hi = max(0, anchor - (q + 1) * PART + 1), min(size - 1, anchor - q * PART)
        if lo > hi:
            continue
        a, b = anchor - q * PART, anchor - (q + 1) * PART + 1 + length
        a, b = max(a, 0), min(b, len(view))
        if a >= b:
            a, b = hi, lo + length
        core = int((h.of(np.array([a]), np.array([b])) ^ mix64(np.array([q & 0xFFFF], np.uint64))).view(np.int64)[0])
        yield start + lo, start + hi, core


# ------------------------------------------------------------ two-stage sorting


def two_stage_order(data: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Start positions in suffix order (to ``depth`` bytes) of a set that holds ``wanted``.

    data must be followed by ``depth`` zero bytes. Suffixes smaller than their successors
    are sorted directly; every other one follows from its successor's place.
    """
    n = len(data) - depth
    # smaller[i]: suffix i < suffix i + 1. Runs of one byte have the type of their last one.
    step = data[1:].astype(np.int16) - data[:-1]
    run_end = np.flatnonzero(step)
    which = np.searchsorted(run_end, np.arange(n))
    smaller = np.where(which < len(run_end), step[run_end[np.minimum(which, len(run_end) - 1)]] > 0, False) if len(run_end) else np.zeros(n, bool)
    # A suffix that is to be induced needs its successors up to the first one that is sorted directly.
    inside = np.zeros(n, bool)
    inside[wanted] = True
    directs = np.flatnonzero(smaller)
    ends = np.searchsorted(directs, wanted)
    stop = np.where(ends < len(directs), directs[np.minimum(ends, max(len(directs) - 1, 0))] if len(directs) else n - 1, n - 1)
    span = stop - wanted + 1
    extra = np.repeat(wanted, span) + np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span)
    inside[extra] = True
    words = _words(data, n)
    induced = inside & ~smaller
    induced[n - 1] = False  # the end of the buffer has no successor to follow
    direct = _sorted_to(words, np.flatnonzero(inside & smaller), depth)
    heads = data[direct]
    by_head = np.searchsorted(heads, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    order: list[np.ndarray] = []
    if inside[n - 1] and not smaller[n - 1]:
        waiting[int(data[n - 1])].append(np.array([n - 1]))  # nothing follows it, so it is the least of its bucket

    def before(rows: np.ndarray) -> np.ndarray:
        p = rows[rows > 0] - 1
        return p[induced[p]]

    for c in range(256):
        found = [np.concatenate(waiting[c])] if waiting[c] else []
        while found and len(more := (p := before(found[-1]))[data[p] == c]):
            found.append(more)
        bucket = np.concatenate([*found, direct[by_head[c] : by_head[c + 1]]])
        if not len(bucket):
            continue
        order.append(bucket)
        p = before(bucket)
        p = p[data[p] > c]
        if len(p):
            p = p[np.argsort(data[p], kind="stable")]
            cuts = np.flatnonzero(np.diff(data[p])) + 1
            for part in np.split(p, cuts):
                waiting[int(data[part[0]])].append(part)
    return np.concatenate(order) if order else np.zeros(0, np.int64)


def _words(data: np.ndarray, n: int) -> np.ndarray:
    """Eight bytes from each position, as a number that sorts like them."""
    m = len(data) - 7
    out = np.zeros(m, np.uint64)
    for k in range(8):
        out |= data[k : k + m].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def _sorted_to(words: np.ndarray, rows: np.ndarray, depth: int) -> np.ndarray:
    """Rows sorted by ``depth`` bytes: by eight bytes, then ties by the next eight, and so on."""
    rows = rows[np.argsort(words[rows], kind="stable")]
    tied = np.zeros(len(rows), bool)
    group = np.zeros(len(rows), np.int64)
    if len(rows):
        same = words[rows[1:]] == words[rows[:-1]]
        tied[1:] |= same
        tied[:-1] |= same
        group = np.cumsum(np.r_[True, ~same])
    at = np.flatnonzero(tied)
    for offset in range(8, depth, 8):
        if not len(at):
            break
        key = words[np.minimum(rows[at] + offset, len(words) - 1)]
        o = np.lexsort((key, group[at]))
        rows[at], key = rows[at][o], key[o]
        g = group[at]
        same = (key[1:] == key[:-1]) & (g[1:] == g[:-1])
        group[at] = g[0] + np.cumsum(np.r_[0, ~same]) if len(at) else g
        still = np.zeros(len(at), bool)
        still[1:] |= same
        still[:-1] |= same
        at = at[still]
    return rows


def common_prefix(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether each suffix shares its first ``length`` bytes with the one before it in the order."""
    words = _words(data, 0)
    same = np.ones(max(len(order) - 1, 0), bool)
    for offset in [*range(0, length - 7, 8), length - 8]:
        at = np.flatnonzero(same)
        same[at] = words[order[1:][at] + offset] == words[order[:-1][at] + offset]
    return np.r_[False, same] if len(order) else np.zeros(0, bool)


def repeats(docs: np.ndarray, starts: np.ndarray, pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of strings in the pieces that equal an earlier string, by (doc, start), of another piece."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    begin = np.cumsum(sizes) - sizes
    depth = (length + 7) // 8 * 8
    data = np.frombuffer(b"".join(pieces) + bytes(depth + 8), np.uint8)
    count = sizes - length + 1
    piece = np.repeat(np.arange(len(pieces)), count)
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    wanted = begin[piece] + inner
    order = two_stage_order(data[: len(data) - 8], wanted, depth)
    doc_at, start_at = np.zeros(len(data), np.int64), np.full(len(data), -1, np.int64)
    doc_at[wanted], start_at[wanted] = docs[piece], starts[piece] + inner
    same = common_prefix(data, order, length)
    run = np.cumsum(~same)
    real = start_at[order] >= 0
    order, run = order[real], run[real]
    o = np.lexsort((start_at[order], doc_at[order], run))
    order, run = order[o], run[o]
    if not len(order):
        return doc_at[:0], start_at[:0]
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    lead = order[first[np.cumsum(np.r_[True, run[1:] != run[:-1]]) - 1]]
    later = (doc_at[order] != doc_at[lead]) | (start_at[order] != start_at[lead])
    return doc_at[order[later]], start_at[order[later]]


def _ranks(doc: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each document among those at hand, and a row of each."""
    order = np.lexsort((part, doc))
    new = np.r_[True, (doc[order][1:] != doc[order][:-1]) | (part[order][1:] != part[order][:-1])] if len(doc) else np.zeros(0, bool)
    rank = np.zeros(len(doc), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, order[new]


def _sort_pieces(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []  # key, doc, part, start, data
        held = 0

        def flush() -> pa.RecordBatch:
            k = np.array([r[0] for r in rows], np.int64)
            edge = np.r_[True, k[1:] != k[:-1], True] if rows else np.zeros(1, bool)
            alone = edge[:-1] & edge[1:]  # nobody shares their key
            at = np.flatnonzero(~alone[: len(rows)]).tolist()
            doc, part, start = (np.array([rows[i][c] for i in at], np.int64) for c in (1, 2, 3))
            rank, of = _ranks(doc, part)
            r, first = repeats(rank, start, [rows[i][4] for i in at], length) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            rows.clear()
            o = np.lexsort((first, r))
            r, first = r[o], first[o]
            new = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (first[1:] > first[:-1] + 1)]) if len(r) else np.zeros(0, np.int64)
            last = np.r_[new[1:], len(r)] - 1 if len(r) else new
            whose = of[r[new]] if len(r) else new
            return pa.RecordBatch.from_arrays([pa.array(doc[whose]), pa.array(part[whose]), pa.array(first[new].astype(np.int32)), pa.array((first[last] - first[new] + 1).astype(np.int32))], names=["doc", "part", "start", "size"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held >= SORTED and row[0] != rows[-1][0]:
                    yield flush()
                    held = 0
                rows.append(row)
                held += len(row[4])
        yield flush()

    return run


# ------------------------------------------------------------------- the whole


def _remove(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, spans, digests = [], [], [], []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                raw = text.as_py()
                data = raw.encode("utf-8", "surrogatepass") if raw else b""
                gone, parts, at, runs = 0, [], 0, 0
                for s, e in _merged(found.as_py() or [], length, len(data)):
                    parts.append(data[at:s])
                    gone, at, runs = gone + e - s, e, runs + 1
                parts.append(data[at:])
                n.append(len(data))
                removed.append(gone)
                spans.append(runs)
                digests.append(hashlib.sha256(b"".join(parts)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _merged(found: list[dict], length: int, n: int) -> Iterator[tuple[int, int]]:
    """Byte runs covered by runs of starts."""
    at = None
    for s, e in sorted((f["start"], min(n, f["start"] + f["size"] + length - 1)) for f in found):
        if at is None:
            at = [s, e]
        elif s <= at[1]:
            at[1] = max(at[1], e)
        else:
            yield at[0], at[1]
            at = [s, e]
    if at:
        yield at[0], at[1]


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST)).alias("doc"), F.xxhash64(text_col).alias("part"), F.col(text_col).alias("text"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, part, found: for each document with repeats, runs (start, size) of starts of strings that also start earlier.

    doc: the id, the smallest long for null; part: ``xxhash64`` of the text.
    """
    rows = _documents(docs, id_col, text_col).drop("doc_id")
    anchors = rows.select("doc", "part", "text").mapInArrow(_anchors(length), _PACKED)
    # Runs known to be repeats only pass through, so they are spread by place, not by their anchor.
    dealt = anchors.repartition(F.when(F.col("place").bitwiseAND(1) == 1, F.xxhash64("doc", "place")).otherwise(F.col("gram")))
    met = keep(dealt.sortWithinPartitions("gram", "digest", "doc", "part", "place").mapInArrow(_collapse, _ROW), "stretches", texts=True)
    differ = met.filter("kind <> 1")
    asked = differ.groupBy("doc", "part").agg(F.collect_list(F.struct("gram", "start", "size", (F.col("kind") == 2).alias("many"))).alias("found"))
    near = prefilter(rows.filter(F.octet_length("text") >= length), F.xxhash64("doc", "part"), differ.select(F.xxhash64("doc", "part").alias("k")).distinct())
    cut = near.join(asked, ["doc", "part"]).select("doc", "part", "text", "found").mapInArrow(_cut(length), "key long, doc long, part long, start int, data binary")
    dealt = cut.repartition("key").sortWithinPartitions("key")
    sorted_out = keep(dealt.mapInArrow(_sort_pieces(length), "doc long, part long, start int, size int"), "sorted", texts=True)
    both = met.filter("kind = 1").select("doc", "part", "start", "size").unionByName(sorted_out)
    out = keep(both.groupBy("doc", "part").agg(F.collect_list(F.struct("start", "size")).alias("found")), "repeats")
    drop(met, sorted_out)
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    by_doc = repeated_spans(docs, length, id_col, text_col)
    rows = may_hold(_documents(docs, id_col, text_col), F.xxhash64("doc", "part"), by_doc.select(F.xxhash64("doc", "part").alias("k")), "maybe")
    none = F.lit(None).cast("array<struct<start:int,size:int>>")
    calm = rows.filter("not maybe").select("doc_id", "text", none.alias("found"))
    met = rows.filter("maybe").join(by_doc, ["doc", "part"], "left").select("doc_id", "text", "found")
    out = calm.unionByName(met).mapInArrow(_remove(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return keep(out, "removed", texts=True)

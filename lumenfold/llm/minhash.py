"""MinHash near-deduplication over an LSH forest.

1. Each text becomes its set of distinct word shingles, hashed to 64 bits, and 128
   minima of it. Texts with one set collapse to the smallest id; only that row goes on.
2. Every tree of the forest is one sorted order of the same rows, by its own sequence
   of minima. Rows are range-partitioned by (tree, sequence, id), so also a region
   that holds a third of all rows is spread over tasks.
3. Neighbours in an order share a prefix. A region is a run of rows with a common
   prefix of ``MIN_DEPTH``; a region of up to ``SMALL`` rows gives all its pairs, a
   denser one gives each row's next neighbours and is cut at the next depth, and so on:
   depth adapts to each region. A region that touches the border of a partition counts as dense.
4. Pairs are weighed by their sketches, then confirmed on the full sets of the texts.
   First each row meets its best smaller partners; after that only pairs whose rows
   are still in different components are confirmed, all of them. So components come
   out as if all pairs had been confirmed, without confirming those inside a group.

5. Rows of regions that were too dense to give all pairs get an exact second look: by the
   prefix filter, two sets that similar share one of the rarest tokens of either, so
   rows with a rare token in common are confirmed if their components still differ. Most
   of them go before: bitmaps of token parities differ in no more bits than the sets
   differ in tokens, so a pair whose bitmaps differ too much is none, with no exception.

A pair at the threshold (0.85) shares a prefix of four in a tree with probability
0.52, so all 32 trees miss it with 5e-11.

Defined results
* null, empty or blank text: no shingles, its own component, linked with nothing.
* fewer words than a shingle: the whole sequence is one shingle.
* rows that repeat: one document; each row gets the same result. Rows that share an id but not a text are
  judged each by its own text.
* null id: linked by its text like any other; it names a component only where nobody in it has an id
  (``component_id`` null).
* ``chosen``: the rows of one document of each component, the one with the smallest id, then text hash.
* empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, keep, prefilter, row_key
from .graph import components

N_HASHES, TREES, MIN_DEPTH, MAX_DEPTH = 128, 32, 4, 12
#: A region of so many rows gives all its pairs; in a larger one each row meets so many next neighbours.
SMALL, NEXT = 12, 3
#: Rows of one region that a task holds; a longer one is looked at in parts.
MOST_HELD = 100_000
#: Partners that each row is confirmed with first.
FIRST = 2

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 2**63, N_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, N_HASHES, dtype=np.uint64)
#: The first MIN_DEPTH minima of the trees are all different; deeper ones are drawn from the rest.
_ORDER = np.stack([np.concatenate([np.arange(t * MIN_DEPTH, (t + 1) * MIN_DEPTH), _rng.permutation([i for i in range(N_HASHES) if i // MIN_DEPTH != t])[: MAX_DEPTH - MIN_DEPTH]]) for t in range(TREES)])


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash of a word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        got = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return got


def shingle_set(text: str | None, size: int, memo: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text."""
    if not text:
        return np.zeros(0, np.uint64)
    w = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, w), np.uint64, len(w))
    k = min(size, len(h))
    s = np.full(len(h) - k + 1, np.uint64(k))
    for i in range(k):
        s = mix64(s + h[i : len(h) - k + 1 + i])
    return np.unique(s)


def minima(s: np.ndarray) -> np.ndarray:
    """128 minima of a non-empty set, 16 low bits each."""
    best = np.full(N_HASHES, np.uint32(0xFFFFFFFF), np.uint32)
    for i in range(0, len(s), 512):
        best = np.minimum(best, ((s[i : i + 512, None] * _A + _B) >> np.uint64(32)).astype(np.uint32).min(0))
    return best.astype(np.uint16)


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            n, lo, hi, sig = [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), size, memo)
                n.append(len(s))
                lo.append(int(s.sum(dtype=np.uint64).astype(np.int64)))
                hi.append(int(mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)))
                sig.append(minima(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "text_key", "n_shingles", "lo", "hi", "sig"])

    return run


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each tree: its key is the tree's sequence of minima, as bytes that sort."""
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            ids = batch.column(0).to_numpy()
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, N_HASHES)
            keys = sig[:, _ORDER].astype(">u2")  # rows, trees, depth
            n = len(ids)
            width = MAX_DEPTH * 2
            flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), n * TREES, [None, pa.py_buffer(np.ascontiguousarray(keys).tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(TREES, dtype=np.int32), n)), flat, pa.array(np.repeat(ids, TREES))], names=["tree", "key", "id"])


def region_pairs(keys: np.ndarray, small: int = SMALL, ahead: int = NEXT, depth: int = MIN_DEPTH) -> list[tuple[int, int]]:
    """Index pairs of one region: sorted keys that share a prefix of ``depth``."""
    n = len(keys)
    if n <= small:
        return [(i, j) for i in range(n) for j in range(i + 1, n)]
    out = [(i, i + d) for d in range(1, ahead + 1) for i in range(n - d)]
    if depth >= keys.shape[1]:
        return out
    deeper = depth + 2
    cut = np.flatnonzero((keys[1:, :deeper] != keys[:-1, :deeper]).any(1)) + 1
    for lo, hi in zip(np.r_[0, cut].tolist(), np.r_[cut, n].tolist(), strict=True):
        if hi - lo > 1:
            out += [(lo + i, lo + j) for i, j in region_pairs(keys[lo:hi], small, ahead, deeper)]
    return out


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk a stretch of the sorted orders; rows of an unfinished region wait for the next batch.

    A pair of a row with itself marks a row whose region may not have given all pairs: it is dense, or it touches
    an end of the stretch, beyond which it may go on.
    """
    left: tuple | None = None
    cut = True  # the next region may have begun before what is held now
    for batch in [*batches, None]:
        last = batch is None
        if last and left is None:
            return
        if not last:
            tree = batch.column(0).to_numpy()
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u2").reshape(-1, MAX_DEPTH).astype(np.uint16)
            ids = batch.column(2).to_numpy()
            if left is not None:
                tree, keys, ids = np.concatenate([left[0], tree]), np.concatenate([left[1], keys]), np.concatenate([left[2], ids])
        else:
            tree, keys, ids = left
        if not len(ids):
            continue
        new = np.flatnonzero((tree[1:] != tree[:-1]) | (keys[1:, :MIN_DEPTH] != keys[:-1, :MIN_DEPTH]).any(1)) + 1
        begin, end = np.r_[0, new], np.r_[new, len(ids)]
        sure = end - begin <= SMALL
        if cut:
            sure[0] = False
        if not last and end[-1] - begin[-1] < MOST_HELD:
            left = (tree[begin[-1] :], keys[begin[-1] :], ids[begin[-1] :])
            cut = cut and len(begin) == 1
            begin, end, sure = begin[:-1], end[:-1], sure[:-1]
        else:
            left, cut = None, True
            sure[-1] = False
        found = []
        for lo, hi, fine in zip(begin.tolist(), end.tolist(), sure.tolist(), strict=True):
            if hi - lo > 1:
                p = np.array(region_pairs(keys[lo:hi]), np.int64) + lo
                found.append(np.stack([ids[p[:, 0]], ids[p[:, 1]]], 1))
            if not fine:
                found.append(np.stack([ids[lo:hi], ids[lo:hi]], 1))
        if found:
            pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _weigh(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, N_HASHES) for i in (2, 3))
            same = (x == y).sum(1)
            ok = same >= least
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[ok]), pa.array(batch.column(1).to_numpy()[ok]), pa.array(same[ok].astype(np.int32))], names=["a", "b", "same"])

    return run


def _confirm(size: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, key, one = WordHashes(), None, np.zeros(0, np.uint64)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            ok = np.zeros(len(ids), bool)
            for k, (a, x, y) in enumerate(zip(ids, batch.column(2), batch.column(3), strict=True)):
                if a != key:
                    key, one = a, shingle_set(x.as_py(), size, memo)
                two = shingle_set(y.as_py(), size, memo)
                both = len(np.intersect1d(one, two, assume_unique=True))
                ok[k] = den * both >= num * (len(one) + len(two) - both) and both > 0
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[ok]), pa.array(batch.column(1).to_numpy()[ok])], names=["a", "b"])

    return run


def near_groups(docs: DataFrame, shingle: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, kept, chosen for every row. text_key: ``xxhash64`` of the text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    signed = keep(rows.mapInArrow(_sign(shingle), "doc_id long, text_key long, n_shingles long, lo long, hi long, sig binary"), "signed", texts=True)
    # Inside, a set of shingles has a number of its own. The row that stands for it: the smallest id, null last, then text.
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    sets = signed.filter("n_shingles > 0").groupBy("n_shingles", "lo", "hi").agg(F.min(F.struct(place.alias("place"), "sig")).alias("m"))
    reps = keep(sets.select(F.monotonically_increasing_id().alias("id"), "n_shingles", "lo", "hi", F.col("m.place").alias("place"), F.col("m.sig").alias("sig")), "representatives")

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    planted = reps.select("id", "sig").mapInArrow(_plant, "tree int, key binary, id long")
    ordered = planted.repartitionByRange(n, "tree", "key", "id").sortWithinPartitions("tree", "key", "id")
    met = keep(ordered.mapInArrow(_neighbours, "a long, b long").distinct(), "met")
    pairs, dense = met.filter("a <> b"), met.filter("a = b").select(F.col("a").alias("id"))
    # One byte of each minimum tells how alike two sets are to 0.03; 4.5 deviations below the threshold none is lost.
    share = percent / 100
    least = int(N_HASHES * (share - 4.5 * (share * (1 - share) / N_HASHES) ** 0.5))
    bytes_of = keep(reps.select("id", "sig").mapInArrow(_low_bytes, "id long, sketch binary"), "sketches")
    weighed = pairs.join(bytes_of.toDF("a", "x"), "a").join(bytes_of.toDF("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(_weigh(least), "a long, b long, same int")
    weighed = keep(weighed, "weighed")
    drop(bytes_of)

    asked = weighed.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = keep(_texts_of(rows, reps, asked), "texts")

    def confirmed(some: DataFrame) -> DataFrame:
        both = some.select("a", "b").join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b").select("a", "b", "x", "y")
        return keep(both.mapInArrow(_confirm(shingle, percent, 100), "a long, b long"), "confirmed", texts=True)

    best = Window.partitionBy("b").orderBy(F.desc("same"), "a")
    first = weighed.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= FIRST)
    links = confirmed(first)
    groups = keep(components(links), "components")
    label = lambda side: F.coalesce(F.col(f"c{side}"), F.col(side))
    apart = weighed.join(groups.toDF("a", "ca"), "a", "left").join(groups.toDF("b", "cb"), "b", "left").filter(label("a") != label("b"))
    apart = apart.join(first.select("a", "b"), ["a", "b"], "left_anti")
    more = confirmed(apart)
    if not more.isEmpty():
        drop(groups)
        links = links.unionByName(more)
        groups = keep(components(links), "components")
    drop(texts, weighed)
    rest = _dense_links(rows, reps, dense, groups, shingle, percent)
    if rest is not None and not rest.isEmpty():
        drop(groups)
        groups = keep(components(links.unionByName(rest)), "components")
    drop(met)
    return _named(signed, reps, groups)


def _texts_of(rows: DataFrame, reps: DataFrame, asked: DataFrame) -> DataFrame:
    """id, text of the sets that ``asked`` (id) names: the text of the row that stands for each."""
    known = keep(reps.join(asked, "id").select("id", F.col("place.doc_id").alias("rep_id"), F.col("place.text_key").alias("rep_key")), "asked")
    near = prefilter(rows, row_key(F.col("doc_id"), F.col("text_key")), known.select(row_key(F.col("rep_id"), F.col("rep_key")).alias("k")))
    met = near.join(known, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("text_key") == F.col("rep_key")))
    return met.select("id", "text").dropDuplicates(["id"])


def _named(signed: DataFrame, reps: DataFrame, groups: DataFrame) -> DataFrame:
    """The component of each row, named by the smallest place in it. Only sets that are linked meet others of their component."""
    linked = groups.join(reps.select(F.col("id").alias("node"), "place"), "node")
    least = linked.groupBy("component_id").agg(F.min("place").alias("least"))
    named = groups.join(least, "component_id").select(F.col("node").alias("id"), "least")
    of_set = reps.join(named, "id", "left").select("n_shingles", "lo", "hi", F.coalesce("least", "place").alias("least"))
    out = signed.select("doc_id", "text_key", "n_shingles", "lo", "hi").join(of_set, ["n_shingles", "lo", "hi"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("least.doc_id")).otherwise(F.col("doc_id"))
    chosen = (F.col("n_shingles") == 0) | (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_key") == F.col("least.text_key")))
    kept = F.when(F.col("doc_id").isNull(), chosen).otherwise(F.col("doc_id").eqNullSafe(component))
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), kept.alias("kept"), chosen.alias("chosen"))


#: Counters of token frequencies, a fixed bound; tokens that share one only blur the order.
COUNTERS = 1 << 20
#: Rows of one token that are compared in one piece, and pairs that a task holds.
TILE, MOST_PAIRS = 1024, 500_000
#: Bits of a parity bitmap.
BITMAP = 1024


def _count_tokens(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, total = WordHashes(), np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for text in batch.column(1):
                np.add.at(total, (shingle_set(text.as_py(), size, memo) % np.uint64(COUNTERS)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["slot", "n"])

    return run


def _rare_tokens(size: int, num: int, den: int, shared):
    """token, id, n, label, bitmap: the rarest tokens of each set, as many as the prefix filter needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, counts = WordHashes(), shared.value
        for batch in batches:
            out = []
            for doc, text, label in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                s = shingle_set(text.as_py(), size, memo)
                need = len(s) - -(-num * len(s) // den) + 1
                c = counts[(s % np.uint64(COUNTERS)).astype(np.int64)]
                first = np.lexsort((s, c))[:need]
                first = first[c[first] > 1]  # nobody else has the others
                bits = np.packbits(np.bincount(((s >> np.uint64(33)) % np.uint64(BITMAP)).astype(np.int64), minlength=BITMAP).astype(np.uint8) & 1).tobytes()
                out += [(t, doc, len(s), label, bits) for t in s[first].view(np.int64).tolist()]
                if len(out) > 20_000:
                    yield pack(out)
                    out = []
            yield pack(out)

    def pack(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.binary())], names=["token", "id", "n", "label", "bitmap"])

    return run


def _across(num: int, den: int):
    """Distinct pairs of rows with one token, different components and sizes that allow a link. Sorted by token and tile."""

    def pairs_of(n, label, doc, bits, part, i, j) -> Iterator[np.ndarray]:
        left = np.flatnonzero(part == i)
        right = left if i == j else np.flatnonzero(part == j)
        # Rows of the most frequent component need not meet each other.
        names, counts = np.unique(label[right], return_counts=True)
        if not len(names):
            return
        big = names[counts.argmax()]
        for rows, cols in ((left[label[left] != big], right), (left[label[left] == big], right[label[right] != big])):
            for at in range(0, len(rows), 256):
                r = rows[at : at + 256]
                ok = (label[r, None] != label[None, cols]) & (den * np.minimum(n[r, None], n[None, cols]) >= num * np.maximum(n[r, None], n[None, cols]))
                a, b = np.nonzero(ok)
                for k in range(0, len(a), 20_000):
                    x, y = r[a[k : k + 20_000]], cols[b[k : k + 20_000]]
                    apart = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64)
                    fine = apart * (den + num) <= (n[x] + n[y]) * (den - num)
                    yield np.sort(np.stack([doc[x[fine]], doc[y[fine]]], 1), axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, found, held = None, [], 0

        def flush() -> pa.RecordBatch:
            p = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])

        def group(x: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, left
            new = np.flatnonzero((x[0][1:] != x[0][:-1]) | (x[1][1:] != x[1][:-1]) | (x[2][1:] != x[2][:-1])) + 1
            begin, end = np.r_[0, new], np.r_[new, len(x[0])]
            stop = len(begin) if last else len(begin) - 1
            for lo, hi in zip(begin[:stop].tolist(), end[:stop].tolist(), strict=True):
                if hi - lo > 1:
                    for p in pairs_of(x[5][lo:hi], x[6][lo:hi], x[4][lo:hi], x[7][lo:hi], x[3][lo:hi], int(x[1][lo]), int(x[2][lo])):
                        found.append(p)
                        held += len(p)
                        if held > MOST_PAIRS:
                            yield flush()
                            held = 0
            left = None if last else [c[begin[-1] :] for c in x]

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy() for c in batch.columns[:7]]
            cols.append(np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint64).reshape(-1, BITMAP // 64))
            yield from group(cols if left is None else [np.concatenate(c) for c in zip(left, cols, strict=True)], False)
        if left is not None:
            yield from group(left, True)
        yield flush()

    return run


def _dense_links(rows: DataFrame, reps: DataFrame, dense: DataFrame, groups: DataFrame, shingle: int, percent: int) -> DataFrame | None:
    """Confirmed links between rows of dense regions that are still in different components: all of them."""
    spark = rows.sparkSession
    if dense.isEmpty():
        return None
    plain = _texts_of(rows, reps, dense.distinct())
    texts = keep(plain.join(groups.toDF("id", "label"), "id", "left").select("id", "text", F.coalesce("label", "id").alias("label")), "texts")
    counted = keep(texts.select("id", "text").mapInArrow(_count_tokens(shingle), "slot long, n long"), "counted", texts=True)
    got = counted.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(COUNTERS, np.int64)
    counts[got["slot"].to_numpy()] = got["n"].to_numpy()
    rare = keep(texts.select("id", "text", "label").mapInArrow(_rare_tokens(shingle, percent, 100, spark.sparkContext.broadcast(counts)), "token long, id long, n long, label long, bitmap binary"), "rare", texts=True)
    tiles = rare.groupBy("token").agg(F.count("*").alias("c"), F.min("label").alias("_l"), F.max("label").alias("_h")).filter("c > 1 and _l < _h").select("token", F.ceil(F.col("c") / TILE).cast("long").alias("tiles"))
    dealt = rare.join(tiles, "token").withColumn("part", F.pmod(F.xxhash64("id"), F.col("tiles")))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("tiles").cast("int") - 1)).alias("other"))
    dealt = dealt.select("token", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "id", "n", "label", "bitmap")
    dealt = dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    pairs = dealt.mapInArrow(_across(percent, 100), "a long, b long").distinct()
    plain = texts.select("id", "text")
    both = pairs.join(plain.toDF("a", "x"), "a").join(plain.toDF("b", "y"), "b").select("a", "b", "x", "y")
    links = keep(both.mapInArrow(_confirm(shingle, percent, 100), "a long, b long"), "confirmed", texts=True)
    drop(texts, rare, counted)
    return links


def _low_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).astype(np.uint8).reshape(-1, N_HASHES)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in sig], pa.binary())], names=["id", "sketch"])

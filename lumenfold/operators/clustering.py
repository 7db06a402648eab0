"""Iterative clustering: spherical k-means and modularity communities.

State is a table of centres or community sums, k by d numbers, which the caller bounds by k;
scenes stay distributed, and a round is one mapInArrow pass with partial sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .settled import settled

#: Centres are held on the driver; k times the dimension may not exceed this many numbers (128 MB).
MOST_STATE = 1 << 24

#: Numbers in a block of vectors (1 MB), and numbers for which a round starts one more task: to start one costs more than to read 4 MB.
BLOCK, PER_TASK = 1 << 17, 1 << 21

#: Scene by centre or community numbers that a task holds at once.
TILE = 1 << 21


def _matrix(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of scenes with vectors of unit norm as bytes: every round reads them, and no number is converted again."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch.column(1))
        step = max(1, BLOCK // x.shape[1])
        lows = range(0, len(x), step)
        ids = pa.ListArray.from_arrays(pa.array([*lows, len(x)], pa.int32()), batch.column(0))
        yield pa.RecordBatch.from_arrays([ids, pa.array([x[lo : lo + step].tobytes() for lo in lows], pa.binary()), pa.array([x.shape[1]] * len(lows), pa.int32())], names=["scenes", "vectors", "d"])


def _tiles(batches: Iterator[pa.RecordBatch], dim: int, centres: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Scenes and vectors out of blocks, so many at once that scenes times centres stay at ``TILE`` or below."""
    step = max(1, TILE // max(1, centres))
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, packed = batch.column(0).flatten(), batch.column(1)
        ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
        x = np.frombuffer(packed.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.float64).reshape(-1, dim)  # the blocks of a batch lie behind one another
        for lo in range(0, len(x), step):
            yield ids[lo : lo + step], x[lo : lo + step]


def _unpack(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _tiles(batches, dim, dim):
            yield pa.RecordBatch.from_arrays([ids, pa.array(x.tolist(), pa.list_(pa.float64()))], names=["scene", "vector"])

    return run


def _stacked(centres: dict[int, np.ndarray]) -> tuple[np.ndarray, dict[int, slice]]:
    """The centres of all runs as one matrix, and which rows of it are a run's."""
    ends = np.cumsum([len(c) for c in centres.values()]).tolist()
    return np.vstack(list(centres.values())), {r: slice(end - len(c), end) for (r, c), end in zip(centres.items(), ends, strict=True)}


def _raw(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _assign_pass(centres: dict[int, np.ndarray]):
    """Partial sums of a round for each run: run, cluster, n, sum of best cosines, sum vector; and the worst-assigned row of the task."""
    stacked, part = _stacked(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, cos, total = np.zeros(len(stacked), np.int64), np.zeros(len(stacked)), np.zeros_like(stacked)
        worst: dict[int, tuple[float, np.ndarray]] = {}
        for _, x in _tiles(batches, stacked.shape[1], len(stacked)):
            sim, at = stacked @ x.T, np.arange(len(x))
            own = np.zeros_like(sim)
            for r, p in part.items():
                label = sim[p].argmax(0)
                best = sim[p][label, at]
                own[p][label, at] = 1
                n[p] += np.bincount(label, minlength=p.stop - p.start)
                cos[p] += np.bincount(label, weights=best, minlength=p.stop - p.start)
                if r not in worst or best.min() < worst[r][0]:
                    worst[r] = float(best.min()), x[best.argmin()]
            total += own @ x
        rows = [(r, c - p.start, int(n[c]), float(cos[c]), total[c].tobytes()) for r, p in part.items() for c in range(p.start, p.stop) if n[c]]
        rows += [(r, -1, 0, at, x.tobytes()) for r, (at, x) in worst.items()]
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.binary()), strict=True)], names=["run", "cluster", "n", "cos", "total"])

    return run


def _pick_pass(centres: dict[int, np.ndarray], seeds: dict[int, int]):
    """For k-means++: each task's weighted choice of each run (exponential race by squared distance)."""
    stacked, part = _stacked(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        won: dict[int, tuple[float, int, np.ndarray]] = {}
        for scenes, x in _tiles(batches, stacked.shape[1], len(stacked)):
            sim, keys = stacked @ x.T, scenes.to_pylist()
            encoded = [str(i).encode() for i in keys]
            for r, p in part.items():
                far = np.maximum(0.0, 2 - 2 * sim[p].max(0)) if p.stop > p.start else np.ones(len(x))
                ids = hash_ids(encoded, seeds[r])
                race = np.where(far > 1e-15, -np.log(ids) / np.maximum(far, 1e-300), np.inf)
                first = int(race.argmin())
                if race[first] < won.get(r, (np.inf,))[0]:
                    won[r] = float(race[first]), keys[first], x[first]
        rows = [(r, at, scene, x.tobytes()) for r, (at, scene, x) in won.items()]
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.float64(), pa.int64(), pa.binary()), strict=True)], names=["run", "race", "scene", "row"])

    return run


def hash_id(key, seed: int) -> float:
    """A number in (0, 1) from a key: draws do not depend on partitions."""
    return (int.from_bytes(hashlib.blake2b(f"{seed}:{key}".encode(), digest_size=8).digest(), "little") + 0.5) / 2.0**64


def hash_ids(keys: list[bytes], seed: int) -> np.ndarray:
    """``hash_id`` of encoded keys."""
    start, blake = f"{seed}:".encode(), hashlib.blake2b
    return (np.frombuffer(b"".join([blake(start + k, digest_size=8).digest() for k in keys]), "<u8") + 0.5) / 2.0**64


def _label_pass(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for scenes, x in _tiles(batches, centres.shape[1], len(centres)):
            sim = x @ centres.T
            yield pa.RecordBatch.from_arrays([scenes, pa.array(sim.argmax(1).astype(np.int32)), pa.array(sim.max(1))], names=["scene", "cluster", "cosine"])

    return run


def spherical_kmeans(scenes: DataFrame, k: int, key: str = "scene", vector: str = "centroid", seed: int = 0, n_init: int = 10, max_iter: int = 300, tol: float = 1e-6, plus: bool = True) -> DataFrame:
    """scene, cluster, cosine: cosine k-means with k-means++ starts; the best of ``n_init`` runs, largest cluster first.

    An empty cluster takes the worst-assigned row; clusters still empty at the end are
    dropped. Runs share the passes over the rows. Draws come from hashes of keys, so a seed gives one result on any cluster.
    Without ``plus`` a run starts from k drawn rows, found in one job. A round is one job over blocks of unit vectors, dealt anew
    by their size: its tasks follow the numbers in them, not the partitions of ``scenes``.
    """
    rows = scenes.select(F.col(key).cast("long").alias("scene"), F.col(vector).alias("vector"))
    packed = settled(rows.mapInArrow(_pack, "scenes array<long>, vectors binary, d int"))
    head = packed.agg(F.sum(F.size("scenes")).alias("n"), F.max("d").alias("d")).first()
    if not head["n"]:
        return rows.select("scene", F.lit(0).alias("cluster"), F.lit(0.0).alias("cosine"))
    dim = head["d"]
    if k < 1 or k * dim > MOST_STATE:
        raise ValueError(f"k must be 1 or more, and k times the dimension at most {MOST_STATE}")
    blocks = packed.repartition(min(-(-head["n"] * dim // PER_TASK), 4 * scenes.sparkSession.sparkContext.defaultParallelism)).persist()
    best, best_cos = None, -np.inf
    together = max(1, MOST_STATE // (k * dim))  # runs that share a pass
    for low in range(0, n_init, together):
        centres = {run: np.zeros((0, dim)) for run in range(low, min(low + together, n_init))}
        for run in [] if plus else list(centres):
            drawn = blocks.mapInArrow(_unpack(dim), "scene long, vector array<double>").orderBy(F.xxhash64("scene", F.lit(seed * 1_000_003 + run)), "scene").limit(k).select("vector").collect()
            centres[run] = np.array([r["vector"] for r in drawn])
        drawing = set(centres) if plus else set()
        for c in range(k):
            if not drawing:
                break
            seeds = {run: seed * 1_000_003 + run * 1009 + c for run in drawing}
            won: dict[int, tuple] = {}
            for r in blocks.mapInArrow(_pick_pass({run: centres[run] for run in drawing}, seeds), "run int, race double, scene long, row binary").collect():  # a row for each run and task
                won[r["run"]] = min(won.get(r["run"], (np.inf,)), (r["race"], r["scene"], r["row"]))
            for run, (_, _, row) in won.items():
                centres[run] = np.vstack([centres[run], np.frombuffer(row)])
            drawing = set(won)
        before: dict[int, tuple] = {}
        for _ in range(max_iter):
            if not centres:
                break
            parts: dict[int, list] = {run: [] for run in centres}
            for p in blocks.mapInArrow(_assign_pass(centres), "run int, cluster int, n long, cos double, total binary").collect():
                parts[p["run"]].append(p)
            for run, held in parts.items():
                old = centres[run]
                n, cos, total = np.zeros(len(old), np.int64), 0.0, np.zeros_like(old)
                worst = min((p for p in held if p["cluster"] < 0), key=lambda p: p["cos"])
                for p in held:
                    if p["cluster"] >= 0:
                        n[p["cluster"]] += p["n"]
                        cos += p["cos"]
                        total[p["cluster"]] += np.frombuffer(p["total"])
                length = np.linalg.norm(total, axis=1, keepdims=True)
                new = np.where(length > 1e-12, total / np.maximum(length, 1e-12), old)
                new[n == 0] = np.frombuffer(worst["total"])
                shift = 1 - float((new * old).sum(1).mean())
                state = (n.tolist(), round(cos, 9))
                if cos > best_cos:
                    best, best_cos = old, cos
                if shift < tol or state == before.get(run):
                    del centres[run]
                else:
                    centres[run], before[run] = new, state
    labelled = blocks.mapInArrow(_label_pass(best), "scene long, cluster int, cosine double")
    sizes = labelled.groupBy("cluster").agg(F.count("*").alias("n"), F.min("scene").alias("first"))
    places = {r["cluster"]: i for i, r in enumerate(sizes.orderBy(F.desc("n"), "first").collect())}  # at most k rows
    order = F.create_map(*[F.lit(int(x)) for kv in places.items() for x in kv])
    return labelled.select("scene", order[F.col("cluster")].alias("cluster"), "cosine")


def _move_pass(shared, gamma: float, share: float, seed: int):
    """Each scene's best community by modularity gain, or one of its own; a drawn share of the scenes may move, as all move at once.

    ``shared``: community sums, sizes, strengths, the whole, 2W, the number of scenes, sorted ids and how labels were renumbered.
    A scene that opens a community takes a label behind those in use.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, sizes, strengths, whole, two_w, n_all, known, renumber = shared.value
        k = len(sizes)
        for batch in batches:
            ids, label = batch.column(0), renumber[batch.column(2).to_numpy()]
            x, keys = _raw(batch.column(1)), ids.to_numpy()
            new, wants = label.copy(), np.zeros(len(x), bool)
            for lo in range(0, len(x), max(1, TILE // k)):
                part = slice(lo, lo + max(1, TILE // k))
                y, at_label = x[part], label[part]
                own = (y * y).sum(1)
                strength = y @ whole - own + n_all - 1
                gain = y @ sums.T
                gain += sizes
                gain -= np.outer(gamma * strength / two_w, strengths)
                at = np.arange(len(y))
                stay = gain[at, at_label] - own - 1 + gamma * strength * strength / two_w
                gain[at, at_label] = stay
                best = gain.argmax(1)
                most = gain[at, best]
                opens = most < 0
                wants[part] = np.maximum(most, 0.0) > stay + 1e-9
                new[part] = np.where(wants[part], np.where(opens, k + np.searchsorted(known, keys[part]), best), at_label)
            turn = np.array([hash_id(i, seed) for i in keys.tolist()]) < share if wants.any() else wants
            yield pa.RecordBatch.from_arrays([ids, batch.column(1), pa.array(np.where(turn, new, label).astype(np.int32)), pa.array(wants)], names=["scene", "vector", "cluster", "wants"])

    return run


def _sum_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, sum of squares, sum vector, first scene and wanted moves of each community of a batch."""
    for batch in batches:
        x = _raw(batch.column(1)) if len(batch.column(1)) else np.zeros((0, 1))
        at, place = np.unique(batch.column(2).to_numpy(), return_inverse=True)
        n, q, wants = (np.bincount(place, weights=w, minlength=len(at)) for w in (None, (x * x).sum(1), batch.column(3).to_numpy(zero_copy_only=False).astype(float)))
        s, first = np.zeros((len(at), x.shape[1])), np.full(len(at), np.iinfo(np.int64).max)
        np.add.at(s, place, x)
        np.minimum.at(first, place, batch.column(0).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(q), pa.array(s.tolist(), pa.list_(pa.float64())), pa.array(first), pa.array(wants.astype(np.int64))], names=["cluster", "n", "q", "s", "first", "wants"])


class _State:
    """Sums of the communities in use, and ``renumber`` from the labels of the rows to their places here."""

    def __init__(self, rows: DataFrame, labels: int, dim: int) -> None:
        got = rows.mapInArrow(_sum_pass, "cluster int, n long, q double, s array<double>, first long, wants long").toArrow()
        at, place = np.unique(got["cluster"].to_numpy(), return_inverse=True)
        k = len(at)
        self.n, self.q, self.s, self.first = np.zeros(k, np.int64), np.zeros(k), np.zeros((k, dim)), np.full(k, np.iinfo(np.int64).max)
        np.add.at(self.n, place, got["n"].to_numpy())
        np.add.at(self.q, place, got["q"].to_numpy())
        np.add.at(self.s, place, got["s"].combine_chunks().flatten().to_numpy().reshape(-1, dim))
        np.minimum.at(self.first, place, got["first"].to_numpy())
        self.wants = int(got["wants"].to_numpy().sum())
        self.renumber = np.full(labels, -1, np.int64)
        self.renumber[at] = np.arange(k)
        self.whole, self.total = self.s.sum(0), int(self.n.sum())
        self.two_w = float(self.whole @ self.whole) - float(self.q.sum()) + self.total * (self.total - 1.0)
        self.strengths = self.s @ self.whole - self.q + self.n * (self.total - 1.0)

    def quality(self, gamma: float) -> float:
        inside = (self.s * self.s).sum(1) - self.q + self.n * (self.n - 1.0)
        return float(inside.sum() / self.two_w - gamma * ((self.strengths / self.two_w) ** 2).sum())

    def merge(self, gamma: float, settled: bool) -> np.ndarray | None:
        """Communities as single nodes moved one by one, until none gains: the place each goes to, or None if all stay.

        Where no scene wants to move (``settled``), communities of one scene cannot gain and are left out.
        """
        own = np.flatnonzero(self.n > 1) if settled else np.arange(len(self.n))
        s, n, strengths = self.s[own], self.n[own].astype(float), self.strengths[own]
        node = s.copy(), n.copy(), strengths.copy()
        label, changed = np.arange(len(own)), False
        while True:
            moved = False
            for i in range(len(own)):
                a, si, ni, ki = label[i], node[0][i], node[1][i], node[2][i]
                s[a], n[a], strengths[a] = s[a] - si, n[a] - ni, strengths[a] - ki
                gain = s @ si + n * ni - gamma * ki * strengths / self.two_w
                gain[n < 0.5] = -np.inf  # empty ones, this one's too if it is alone: staying alone gains 0
                b = int(gain.argmax())
                here = gain[a] if n[a] >= 0.5 else 0.0
                if not gain[b] > here + 1e-9:
                    b = a
                s[b], n[b], strengths[b] = s[b] + si, n[b] + ni, strengths[b] + ki
                if b != a:
                    label[i], moved, changed = b, True, True
            if not moved:
                break
        out = np.arange(len(self.n))
        out[own] = own[label]
        return out if changed else None


def _relabel(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value[batch.column(2).to_numpy()].astype(np.int32))], names=["scene", "cluster"])

    return run


def communities(scenes: DataFrame, key: str = "scene", vector: str = "centroid", gamma: float = 2.0, start: int | None = None, sweeps: int = 30, seed: int = 0) -> DataFrame:
    """scene, cluster: Louvain-style communities of the complete graph with weights dot + 1, largest first.

    Gains come from broadcast community sums, so no edges arise. Every scene starts alone, or
    in one of ``start`` k-means groups; it may move to any community or open one, so their number
    follows the data. In a sweep a drawn share of the scenes moves; a sweep that
    does not raise modularity is taken back and the share halved, so scenes do not all
    run to one place. Then whole communities move as long as modularity gains, and scenes again. No
    result is worse than all scenes alone. The complete graph makes every community connected.
    Sums take scenes times dimension numbers on the driver, at most ``MOST_STATE``; a sweep compares every scene with every community.
    Identity with other Louvain or Leiden implementations is not claimed.
    """
    spark = scenes.sparkSession
    rows = scenes.select(F.col(key).cast("long").alias("scene"), F.col(vector).cast("array<double>").alias("vector")).persist()
    head = rows.select(F.size("vector").alias("d")).first()
    if head is None:
        return rows.select("scene", F.lit(0).alias("cluster"))
    dim = head["d"]
    if rows.count() * dim > MOST_STATE:
        raise ValueError(f"scenes times the dimension may be at most {MOST_STATE}")
    known = np.unique(rows.select("scene").toArrow()["scene"].to_numpy())

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.searchsorted(known, batch.column(0).to_numpy()).astype(np.int32)), pa.array(np.zeros(batch.num_rows, bool))], names=["scene", "vector", "cluster", "wants"])

    shape = "scene long, vector array<double>, cluster int, wants boolean"
    single = rows.mapInArrow(alone, shape).persist()
    now = _State(single, len(known), dim)
    least, current = now.quality(gamma), single
    if start is not None:
        base = spherical_kmeans(scenes, start, key, vector, seed, n_init=1, max_iter=6, plus=False)
        current = rows.join(base.select("scene", "cluster"), "scene").select("scene", "vector", F.col("cluster").cast("int").alias("cluster"), F.lit(False).alias("wants")).persist()
        now = _State(current, start, dim)
    share, settled, sweep = 0.5, False, 0
    while True:
        while sweep < sweeps and share >= 1 / 64 and not settled:
            shared = spark.sparkContext.broadcast((now.s, now.n, now.strengths, now.whole, now.two_w, now.total, known, now.renumber))
            moved = current.mapInArrow(_move_pass(shared, gamma, share, seed * 1009 + sweep), shape).persist()
            then = _State(moved, len(now.n) + len(known), dim)
            sweep += 1
            settled = then.wants == 0
            if not settled and then.quality(gamma) > now.quality(gamma) + 1e-12:
                current, now = moved, then
            else:
                moved.unpersist()
                share /= 2
        to = now.merge(gamma, settled)
        if to is None:
            break
        # The same rows under merged labels; scenes may then move again.
        shared = spark.sparkContext.broadcast(to[now.renumber])
        current = current.select("scene", "vector", "cluster").mapInArrow(_merged(shared), shape).persist()
        now = _State(current, len(to), dim)
        share, settled = max(share, 1 / 8), False
    if now.quality(gamma) < least:
        return communities(scenes, key, vector, gamma, None, sweeps, seed)
    place = np.empty(len(now.n), np.int64)
    place[np.lexsort((now.first, -now.n))] = np.arange(len(now.n))
    return current.mapInArrow(_relabel(spark.sparkContext.broadcast(place[now.renumber])), "scene long, cluster int")


def _merged(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = shared.value[batch.column(2).to_numpy()].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(label), pa.array(np.zeros(len(label), bool))], names=["scene", "vector", "cluster", "wants"])

    return run


def select_subset(members: DataFrame, cluster: str, ordinal: str, min_size: int = 1, k: int | None = None, percent: float | None = None) -> DataFrame:
    """The first members of each large enough cluster: k of them, or a share rounded half-even, at least one."""
    sizes = members.groupBy(cluster).agg(F.count("*").alias("_size")).filter(F.col("_size") >= min_size)
    both = members.join(sizes, cluster)
    n = F.lit(k) if k is not None else F.greatest(F.lit(1), F.bround(F.col("_size") * percent / 100.0).cast("int"))
    return both.filter(F.col(ordinal) < F.least("_size", n)).drop("_size")

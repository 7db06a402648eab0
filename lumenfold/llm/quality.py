"""Quality classifier: weak labellers, expectation-maximisation, hashed linear scorers.

Two questions are asked of a text, whether it is good and whether it is clean of insults, each in the same way:

1. Overlapping heuristic labellers look at a whole text and vote good, bad or nothing. Human labels,
   where a text has them, are one more labeller; no labeller decides alone.
2. Votes are counted by pattern over all documents. There are at most 3 ** labellers
   patterns, so expectation-maximisation runs on a table of fixed bound, and gives each
   labeller's accuracy and each pattern's posterior of being good.
3. Posteriors are the targets of a linear scorer. It is fitted on a bounded sample, and its score alone decides.

For quality the scorer has hashed features (word shapes, levels of statistics) and is fitted on ``SAMPLE``
documents, those with the smallest hashes. For toxicity the labellers are a list of insults (any, and two or more) and
``labels.toxic``; features are the votes of the list and markers: whole words and word beginnings that
toxic documents have more often than others (at most ``MARKERS``, by likelihood ratio), each with its share of the
text's words. It is fitted on ``TOXIC_SAMPLE`` documents: labelled ones, where some are labelled toxic and some
clean, else any. Texts pass through Python once:
features are stored, and scores come from them.

Defined results
* null, empty or blank text: score 0, rejected (nothing to learn from).
* rows that repeat: each row by itself; labels that repeat: the lower quality counts, and the higher toxicity.
* a label with an id that several rows have holds for all of them; null ids have no labels.
* empty table: no rows. Labels may be missing or empty. Extra columns pass through in ``filter_documents``.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, keep, without

#: Documents that the linear scorer is fitted on, at most, and the size of its hashed weight vector.
SAMPLE, BUCKETS = 6000, 1 << 14
STEPS, RATE, DECAY = 72_000, 0.5, 1e-5
THRESHOLD = 0.5
#: Labelled documents that the toxicity scorer is fitted on, and its markers, at most.
TOXIC_SAMPLE, MARKERS = 6000, 400
#: Documents that the list of insults, and human labels of toxicity, are trusted for in advance: toxic texts can be very few.
TRUST = (20.0, 20.0, 100_000.0)
#: A marker has so many toxic documents and such a likelihood ratio at least; word beginnings have these lengths.
MARKER_DOCS, MARKER_RATIO, STEMS = 3, 15.0, (3, 4, 5, 6, 7)

#: Frequent function words of the languages at hand.
FUNCTION_WORDS = frozenset("the of and to in is that for it as was with be by on are this le la les de des et un une est que qui dans pour pas sur der die das und in den von zu mit ist ein nicht el los las y en por con no se es".split())
#: Insults.
INSULTS = frozenset("stupid idiot idiots moron morons loser losers scum trash garbage pathetic disgusting worthless clown dumb imbecile scumbag bastard bitch asshole shithead fuck fucking retard freak jerk".split())
SYMBOLS = frozenset("%*&$#@|~^=+<>{}[]\\_!")
_SHAPES = ((re.compile(r"[^\W\d_]+"), "a"), (re.compile(r"\d+"), "0"), (re.compile(r"(.)\1+"), r"\1\1"))
_EDGE = re.compile(r"^[^\w]+|[^\w]+$")


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS


_PLAIN = {(shout, tail): _bucket(f"shape {shout} a{tail}") for shout in (False, True) for tail in ("", ".", ",")}


class Words(dict):
    """What a word adds to a text: (shape bucket, shout, symbol, bare), remembered up to a bound."""

    def __missing__(self, w: str) -> tuple[int, bool, bool, bool]:
        # Plain words, alone or before a full stop or comma, are most of a text and cost less than a place here.
        tail = w[-1] if w[-1] in ".," else ""
        plain = w[:-1] if tail else w
        if plain.isalpha():
            shout = len(w) > 1 and plain.isupper()
            return _PLAIN[shout, tail], shout, False, False
        if len(self) > 50_000:
            self.clear()
        shape = w
        for pattern, to in _SHAPES:
            shape = pattern.sub(to, shape)
        shout = len(w) > 1 and w.isupper()
        got = self[w] = (_bucket(f"shape {shout} {shape}"), shout, w[-1] in SYMBOLS and w[-2:-1] in SYMBOLS, not any(map(str.isalnum, w)))
        return got


class Profile:
    """One text: its words, statistics (shares between 0 and 1, and the mean word length) and counts of word shapes."""

    def __init__(self, text: str, memo: Words) -> None:
        words = text.split()
        self.n = n = len(words)
        self.stats: dict[str, float] = {}
        self.shapes: dict[int, int] = {}
        self.counts = counts = Counter(words)
        if not n:
            return
        shout = symbol = bare = 0
        shapes = self.shapes
        for w, c in counts.items():
            bucket, is_shout, is_symbol, is_bare = memo[w]
            shapes[bucket] = shapes.get(bucket, 0) + c
            if is_shout:
                shout += c
            if is_symbol:
                symbol += c
            if is_bare:
                bare += c
        lines = [x for x in text.split("\n") if x.strip()]
        self.stats = {
            "shout": shout / n,
            "symbol": symbol / n,
            "bare": bare / n,
            "stutter": sum(map(eq, words, words[1:])) / n,
            "top": (max(counts.values()) - 1) / n,
            "same": 1 - len(set(zip(words, words[1:], words[2:], strict=False))) / (n - 2) if n > 2 else 0.0,
            "lines": 1 - len(set(lines)) / max(len(lines), 1),
            "length": sum(map(len, words)) / n,
            "function": sum(counts[w] for w in counts.keys() & FUNCTION_WORDS) / n,
        }


#: A labeller votes bad at or beyond the second figure and good before the first one.
LABELLERS = {
    "shout": (0.03, 0.12),
    "symbol": (0.01, 0.05),
    "bare": (0.02, 0.08),
    "stutter": (0.04, 0.12),
    "top": (0.17, 0.3),
    "same": (0.15, 0.35),
    "lines": (0.2, 0.5),
}
#: These vote bad below the first figure and good from the second one on.
RISING = {"function": (0.02, 0.1)}
NAMES = (*LABELLERS, *RISING, "length", "label")


def votes(stats: dict[str, float]) -> list[int]:
    out = [-1 if stats[k] >= hi else 1 if stats[k] < lo else 0 for k, (lo, hi) in LABELLERS.items()]
    out += [-1 if stats[k] < lo else 1 if stats[k] >= hi else 0 for k, (lo, hi) in RISING.items()]
    out.append(1 if 2.5 <= stats["length"] <= 9 else -1 if stats["length"] > 25 or stats["length"] < 1.5 else 0)
    return out


_LEVELS = (0.005, 0.01, 0.02, 0.04, 0.08, 0.12, 0.2, 0.3, 0.5, 2, 4, 6, 8, 12, 25)
_STATISTICS = ("shout", "symbol", "bare", "stutter", "top", "same", "lines", "length", "function")
_LEVEL_BUCKETS = {k: [_bucket(f"{k} {i}") for i in range(len(_LEVELS) + 1)] for k in _STATISTICS}


def features(p: Profile) -> dict[int, float]:
    """Hashed features of a text: root shares of word shapes, and the level of each statistic."""
    out = {k: (c / p.n) ** 0.5 for k, c in p.shapes.items()}
    for name, value in p.stats.items():
        k = _LEVEL_BUCKETS[name][bisect_right(_LEVELS, value)]
        out[k] = out.get(k, 0.0) + 1.0
    return out


# ---------------------------------------------------------------- toxicity


def insults(text: Column) -> Column:
    """How many words of a text are listed insults. Native, as all texts are asked."""
    found = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w.isin(*sorted(INSULTS)))
    return F.coalesce(F.size(found), F.lit(0))


def grams(word: str) -> tuple[str, ...]:
    """The whole word, with a line end behind it, and its beginnings; short words have none."""
    w = _EDGE.sub("", word).lower()
    return (w + "\n", *(w[:k] for k in STEMS if len(w) > k)) if len(w) >= STEMS[0] else ()


def _weight(count: int, n: int) -> float:
    return min(3.0, 30.0 * count / n)


class Toxic:
    """Markers and votes of the list with their weights, and a bias."""

    def __init__(self, markers: list[str], weights: np.ndarray) -> None:
        self.place = {m: i for i, m in enumerate(markers)}
        self.weights = weights.tolist()  # of markers, of the two votes, bias
        self.memo: dict[str, tuple[int, ...]] = {}

    def marked(self, counts: Counter) -> dict[int, int]:
        """Words of a text that have each marker."""
        memo, found = self.memo, {}
        for w, c in counts.items():
            got = memo.get(w)
            if got is None:
                if len(memo) > 100_000:
                    memo.clear()
                got = memo[w] = tuple(self.place[g] for g in grams(w) if g in self.place)
            for i in got:
                found[i] = found.get(i, 0) + c
        return found

    def features(self, counts: Counter, n: int, listed: int) -> list[tuple[int, float]]:
        out = [(i, _weight(c, n)) for i, c in self.marked(counts).items()]
        m = len(self.place)
        return sorted(out + [(m, 1.0)] * (listed > 0) + [(m + 1, 1.0)] * (listed > 1))

    def __call__(self, counts: Counter, n: int, listed: int) -> float:
        return sum(self.weights[i] * x for i, x in self.features(counts, n, listed)) + self.weights[-1]


def _grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posterior mass of toxic and of clean texts that hold each gram: partial sums of a task over a bounded sample."""
    memo: dict[str, tuple[str, ...]] = {}
    mass: dict[str, list[float]] = {}
    for batch in batches:
        for bad, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            held: set[str] = set()
            for w in set((text.as_py() or "").split()):
                if (got := memo.get(w)) is None:
                    if len(memo) > 200_000:
                        memo.clear()
                    got = memo[w] = grams(w)
                held.update(got)
            for g in held:
                m = mass.get(g)
                if m is None:
                    mass[g] = [bad, 1 - bad]
                else:
                    m[0] += bad
                    m[1] += 1 - bad
            if len(mass) > 500_000:
                yield _masses(mass)
                mass.clear()
    yield _masses(mass)


def _masses(mass: dict[str, list[float]]) -> pa.RecordBatch:
    a, b = ([m[k] for m in mass.values()] for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(list(mass), pa.string()), pa.array(a, pa.float64()), pa.array(b, pa.float64())], names=["gram", "a", "b"])


def _marked_of(toxic: Toxic):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, values = [], []
            for text, listed in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = (text.as_py() or "").split()
                held = toxic.features(Counter(words), len(words), listed)
                keys.append([k for k, _ in held])
                values.append([v for _, v in held])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], names=["bad", "keys", "vals"])

    return run


def learn_toxic(rows: DataFrame, told: DataFrame) -> Toxic:
    """``rows``: doc_id, text, text_key; ``told``: doc_id, text_key, bad (posterior of being toxic), listed; no more than a bounded sample."""
    texts = rows.join(F.broadcast(told), ["doc_id", "text_key"]).select("bad", "text", "listed")
    texts = keep(texts, "toxic")
    total = texts.agg(F.sum("bad").alias("a"), F.sum(1 - F.col("bad")).alias("b")).first()
    if not total["a"] or not total["b"]:
        drop(texts)
        return Toxic([], np.array([0.0, 0.0, -1.0]))
    each = texts.select("bad", "text").mapInArrow(_grams_of, "gram string, a double, b double").groupBy("gram").agg(F.round(F.sum("a"), 6).alias("a"), F.round(F.sum("b"), 6).alias("b"))
    share = total["a"] / (total["a"] + total["b"])
    a, b, both = F.col("a"), F.col("b"), F.col("a") + F.col("b")
    ratio = 2 * (a * F.log(a / (both * share)) + F.when(b > 0, b * F.log(b / (both * (1 - share)))).otherwise(0.0))
    often = each.filter((a >= MARKER_DOCS) & (a > both * share)).withColumn("ratio", ratio).filter(F.col("ratio") >= MARKER_RATIO)
    markers = [r["gram"] for r in often.orderBy(F.round("ratio", 9).desc(), "gram").limit(MARKERS).collect()]
    made = Toxic(markers, np.zeros(len(markers) + 3))
    got = texts.select("bad", "text", "listed").mapInArrow(_marked_of(made), "bad double, keys array<int>, vals array<double>").collect()
    drop(texts)
    fitted = sorted((list(r["keys"]), list(r["vals"]), r["bad"]) for r in got)
    weights = fit(fitted)
    return Toxic(markers, np.append(weights[: len(markers) + 2], weights[BUCKETS]))


# ------------------------------------------------------------------ labels


def weak_labels(patterns: dict[str, int], rounds: int = 60, labellers: tuple[str, ...] = NAMES, trust: float | tuple[float, ...] = 2.0, start: tuple[float, float, float] = (0.5, 2.5, 4.0), silence: bool = True) -> tuple[dict[str, float], dict[str, float]]:
    """Posterior of being good for each vote pattern, and each labeller's accuracy, by expectation-maximisation.

    ``trust``: documents that each labeller is taken to have judged rightly before any is seen, against one of each other vote.
    ``start``: weights of a good vote, a bad one and the last labeller's in the first guess; a bad vote weighs more, as
    most labellers look for one kind of damage each. ``silence``: whether no vote tells something too.
    """
    names = sorted(patterns)
    if not names:
        return {}, {}
    count = np.array([patterns[p] for p in names], float)
    vote = np.array([[1 if c == "+" else -1 if c == "-" else 0 for c in p] for p in names])
    good = 1 / (1 + np.exp(-(start[0] * (vote > 0).sum(1) - start[1] * (vote < 0).sum(1) + start[2] * vote[:, -1])))
    accuracy = np.zeros(vote.shape[1])
    for _ in range(rounds):
        table = np.zeros((2, 3, vote.shape[1]))  # class, vote, labeller
        for z, weight in enumerate(((1 - good) * count, good * count)):
            for v in (-1, 0, 1):
                table[z, v + 1] = ((vote == v) * weight[:, None]).sum(0) + (np.asarray(trust) if v == (1 if z else -1) else 1.0)
        if not silence:
            table[:, 1] = 0
        table /= table.sum(1, keepdims=True)
        if not silence:
            table[:, 1] = 1
        prior = float((good * count).sum() / count.sum())
        prior = min(max(prior, 1e-3), 1 - 1e-3)
        j = np.arange(vote.shape[1])
        odds = np.log(prior / (1 - prior)) + (np.log(table[1][vote + 1, j]) - np.log(table[0][vote + 1, j])).sum(1)
        good = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        told = (vote != 0) * count[:, None]
        right = ((vote > 0) * good[:, None] + (vote < 0) * (1 - good)[:, None]) * count[:, None]
        accuracy = right.sum(0) / np.maximum(told.sum(0), 1e-9)
    return dict(zip(names, good.tolist(), strict=True)), dict(zip(labellers, accuracy.tolist(), strict=True))


def fit(rows: list[tuple[list[int], list[float], float]]) -> np.ndarray:
    """Weights of a logistic scorer, adaptive steps, fixed order. The last weight is the bias."""
    w, g = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-6)
    rows = [(np.array([*k, BUCKETS], np.int64), np.array([*v, 1.0]), y) for k, v, y in rows]
    rng = np.random.default_rng(11)
    for _ in range(-(-STEPS // max(len(rows), 1)) if rows else 0):
        for i in rng.permutation(len(rows)).tolist():
            k, v, y = rows[i]
            d = (1 / (1 + np.exp(-np.clip(w[k] @ v, -30, 30))) - y) * v + DECAY * w[k]
            g[k] += d * d
            w[k] -= RATE * d / np.sqrt(g[k])
    return w


class Model:
    """Weights of the quality scorer, accuracies and posteriors of both questions, and the toxicity scorer."""

    def __init__(self, weights: np.ndarray, accuracy: dict[str, float], patterns: dict[str, float], toxic: Toxic) -> None:
        self.weights, self.accuracy, self.patterns, self.toxic = weights, accuracy, patterns, toxic


_LOOKED = "doc_id long, text_key long, votes string, toxic double, keys array<int>, vals array<float>"


def _look(toxic: Toxic):
    """Votes on quality, the toxicity score and the hashed features of each text. Null votes: no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Words()
        for batch in batches:
            told, scores, keys, values = [], [], [], []
            for text, listed in zip(batch.column(1), batch.column(3).to_pylist(), strict=True):
                p = Profile(text.as_py() or "", memo)
                f = features(p)
                told.append("".join("-0+"[v + 1] for v in votes(p.stats)) if p.n else None)
                scores.append(toxic(p.counts, p.n, listed) if p.n else 0.0)
                keys.append(list(f))
                values.append(list(f.values()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(told, pa.string()), pa.array(scores, pa.float64()), pa.array(keys, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], names=["doc_id", "text_key", "votes", "toxic", "keys", "vals"])

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"), insults(text).alias("listed"))


def _told(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """doc_id, text_key, listed and the human votes of every row; no texts."""
    each = rows.select("doc_id", "text_key", "listed")
    if labels is None:
        return each.withColumns({"good": F.lit("0"), "clean": F.lit("0")})
    toxic = F.col("toxic") if "toxic" in labels.columns else F.lit(None)
    by = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(toxic).cast("int").alias("t"))
    good = F.when(F.col("q") == 1, "+").when(F.col("q") == 0, "-").otherwise("0")
    clean = F.when(F.col("t") == 0, "+").when(F.col("t") == 1, "-").otherwise("0")
    return each.join(by, "doc_id", "left").select("doc_id", "text_key", "listed", good.alias("good"), clean.alias("clean"))


def _count(patterns: DataFrame) -> dict[str, int]:
    """pattern -> rows; there are 3 ** labellers patterns at most."""
    return {r["pattern"]: r["n"] for r in patterns.groupBy("pattern").agg(F.count("*").alias("n")).collect()}


def _drawn(df: DataFrame, n: int, *first: Column) -> DataFrame:
    """A sample by a hash of the row, so that it does not depend on partitions."""
    return df.orderBy(*first, F.xxhash64("doc_id", "text_key", F.lit(17)), "doc_id", "text_key").limit(n)


def _learn_toxicity(rows: DataFrame, told: DataFrame) -> Toxic:
    any_listed = F.when(F.col("listed") > 0, "-").otherwise("+")
    many_listed = F.when(F.col("listed") > 1, "-").otherwise("0")
    voted = told.withColumn("pattern", F.concat(any_listed, many_listed, "clean"))
    counts = _count(voted)
    posterior, _ = weak_labels(counts, labellers=("list", "list twice", "label"), trust=TRUST, start=(3.0, 3.0, 6.0), silence=False)
    if not posterior:
        return Toxic([], np.array([0.0, 0.0, -1.0]))
    known = F.create_map(*[F.lit(x) for kv in sorted(posterior.items()) for x in kv])
    # Where people told toxic and clean texts apart, theirs are the sample: posteriors of others are no better than the list.
    if {p[-1] for p in counts} >= {"+", "-"}:
        voted = voted.filter("clean <> '0'")
    sample = _drawn(voted.select("doc_id", "text_key", "listed", (1 - known[F.col("pattern")]).alias("bad")), TOXIC_SAMPLE)
    return learn_toxic(rows, sample.dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text_key", "bad", "listed"))


def _learn(docs: DataFrame, labels: DataFrame | None, sample: int, id_col: str, text_col: str) -> tuple[Model, DataFrame]:
    """The model, and the features of all rows."""
    rows = _rows(docs, id_col, text_col)
    told = keep(_told(rows, labels), "told")
    toxic = _learn_toxicity(rows.drop("listed"), told)
    looked = keep(rows.mapInArrow(_look(toxic), _LOOKED), "looked", texts=True)
    human = told.select("doc_id", "text_key", "good").distinct()
    voted = looked.select("doc_id", "text_key", "votes").filter("votes is not null").join(human.withColumnsRenamed({"doc_id": "_d", "text_key": "_k"}), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_k")))
    voted = keep(voted.select("doc_id", "text_key", F.concat("votes", "good").alias("pattern")), "votes")
    posterior, accuracy = weak_labels(_count(voted))
    chosen = _drawn(voted, sample).dropDuplicates(["doc_id", "text_key"])
    # The sample is bounded by its parameter; only its features leave the executors.
    picked = looked.join(F.broadcast(chosen.withColumnsRenamed({"doc_id": "_d", "text_key": "_k"})), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_k")))
    got = picked.dropDuplicates(["doc_id", "text_key"]).select("pattern", "keys", "vals").collect()
    fitted = sorted((list(r["keys"]), list(r["vals"]), posterior[r["pattern"]]) for r in got)
    drop(voted, told)
    return Model(fit(fitted), accuracy, posterior, toxic), looked


def train(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Count votes over all documents, weigh labellers, fit the scorers on bounded samples."""
    model, looked = _learn(docs, labels, sample, id_col, text_col)
    drop(looked)
    return model


def _score(weights: np.ndarray):
    """score of stored features; no words: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, vals = batch.column(4), batch.column(5)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            k, v = lists.flatten().to_numpy(), vals.flatten().to_numpy().astype(np.float64)
            x = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights[k] * v, len(sizes)) + weights[BUCKETS]
            fine = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            score = np.where(fine, 1 / (1 + np.exp(-np.clip(x, -30, 30))), 0.0)
            bad = batch.column(3).to_numpy() >= 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array(fine & bad)], names=["doc_id", "text_key", "score", "toxic"])

    return run


def _judged(looked: DataFrame, model: Model) -> DataFrame:
    got = looked.mapInArrow(_score(model.weights), "doc_id long, text_key long, score double, toxic boolean")
    return got.withColumn("kept", (F.col("score") >= THRESHOLD) & ~F.col("toxic"))


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, score, toxic, kept for every row, by a model that was trained before."""
    return _judged(keep(_rows(docs, id_col, text_col).mapInArrow(_look(model.toxic), _LOOKED), "looked", texts=True), model)


def train_and_classify(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same for the documents that the model is trained on: texts are looked at once."""
    model, looked = _learn(docs, labels, sample, id_col, text_col)
    return _judged(looked, model)


def filter_documents(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The accepted rows, with the columns they have. Rows are known by id and text."""
    judged = keep(train_and_classify(docs, labels, id_col=id_col, text_col=text_col), "judged")
    return without(docs, judged.filter("not kept").select("doc_id", "text_key"), id_col, text_col)

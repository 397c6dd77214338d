"""Quality scores learned from preferences: a Bradley-Terry model over features of whole texts.

Every document has a worth, linear in its features; that one document is preferred to another has the logistic
probability of the difference of their worths. Preference pairs set a labelled good document against a labelled bad one,
and weights minimise the logistic loss on the differences of features (Newton's method, with a small ridge). The threshold
is a quantile: as large a share of the labelled documents falls below it as is labelled 0. The score is the logistic of
the distance to it, moved so that the threshold scores THRESHOLD.

All labelled documents are learned from. They are dealt to blocks of some BLOCK documents of the commoner label, and all pairs
within a block count, so that every document stands in pairs and their number grows with the documents, not with their
square. Sums over pairs and the threshold, which is exact, are made by Spark. Labels meet features, never texts: no text is
shuffled, and train_and_score() reads each text once for both.

Defined results: null and empty texts have features too (all zero but one) and so a score; a null doc_id isn't held
out and isn't learned from; labels other than 0 and 1 are ignored; a document labelled twice counts for each label; of
rows that share a labelled doc_id one is learned from; without examples of both labels every score is the share of
label 1 (or 0.5) and nothing is read from the text; very long texts are read whole, in stretches whose features are
averaged by length; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.llm import common as C

#: Documents of the commoner label in a block, and the most parts that blocks are summed in.
BLOCK, PARTS = 256, 200
THRESHOLD = 0.3
STRETCH = 1 << 20
RIDGE = 1e-3

_KIND = np.zeros(256, dtype=np.int64)
for _k, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r", b".,;:", b"!?", b"\"'()-", b"|<>[]{}\\/=_", b"#$%&*+@^`~", bytes(range(0x80, 0x100))), 1):
    _KIND[list(_bytes)] = _k
_KINDS = int(_KIND.max()) + 1
NAMES = ["empty", "log_words", "word_length", "word_length_spread", "long_words", "letter_ends", "distinct", "commonest", "repeats", "new_pairs", "lines", "distinct_lines", "capitals"] + [f"kind_{k}" for k in range(_KINDS)]


def _stretch_features(data: bytes) -> np.ndarray:
    words = data.split()
    if not words:
        return np.zeros(len(NAMES))
    n = len(words)
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=n)
    ends = np.fromiter((w[-1] for w in words), dtype=np.uint8, count=n)
    low = [w.lower() for w in words]
    counts = Counter(low)
    pairs = list(zip(low, low[1:]))
    lines = [x for x in data.split(b"\n") if x.strip()]
    kinds = np.bincount(_KIND[np.frombuffer(data, dtype=np.uint8)], minlength=_KINDS) / len(data)
    return np.concatenate((
        [0.0, np.log1p(n), min(lengths.mean(), 50.0), min(lengths.std(), 50.0), (lengths > 24).mean(), ((_KIND[ends] <= 2) | (_KIND[ends] == 6) | (ends >= 0x80)).mean()],
        [np.log(n) and np.log(len(counts)) / np.log(n), max(counts.values()) / n, sum(a == b for a, b in pairs) / n, len(set(pairs)) / max(1, len(pairs))],
        [np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), sum(w[:1].isupper() for w in words) / n],
        kinds,
    ))


def features(text: str) -> np.ndarray:
    """Shares and logarithms that don't grow with the text, over the whole of it."""
    data = text.encode()
    if not data.strip():
        return np.eye(len(NAMES))[0]
    total, size, at = np.zeros(len(NAMES)), 0, 0
    while at < len(data):
        to = at + STRETCH
        space = data.find(b" ", to, to + STRETCH) if to < len(data) else -1
        piece = data[at : space if space >= 0 else to]
        total, size, at = total + _stretch_features(piece) * len(piece), size + len(piece), at + len(piece)
    return total / size


@dataclass
class Model:
    """Weights of a document's worth over spread features, and the worth at the threshold; rate stands in where nothing could be learned."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    rate: float = 0.5

    def worth(self, x: np.ndarray) -> np.ndarray:
        return _spread(x, self.mean, self.spread) @ self.weights

    def scores(self, texts: list[str]) -> np.ndarray:
        if not len(self.weights) or not texts:
            return np.full(len(texts), self.rate)
        return self.scores_of(np.stack([features(t) for t in texts]))

    def scores_of(self, x: np.ndarray) -> np.ndarray:
        at = self.worth(x) - self.threshold + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(at, -500, 500)))


def _spread(x: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Standardized features, bounded, with what lies above and below the usual as features of their own."""
    z = np.clip((x - mean) / spread, -6, 6)
    return np.concatenate((z, np.maximum(z - 1, 0), np.maximum(-z - 1, 0)), axis=1)


def _newton(sums: Callable[[np.ndarray], np.ndarray], size: int, ridge: float, steps: int) -> np.ndarray:
    """Weights at which the gradient of a convex loss and a ridge vanishes. sums: of all pairs, for weights: their number,
    the gradient, and the second derivatives, in one array."""
    w = np.zeros(size)
    for _ in range(steps):
        found = sums(w)
        gradient = found[1 : size + 1] / found[0] + ridge * w
        step = np.linalg.solve(found[size + 1 :].reshape(size, size) / found[0] + ridge * np.eye(size), gradient)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def bradley_terry(better: np.ndarray, worse: np.ndarray, ridge: float = RIDGE, steps: int = 25) -> np.ndarray:
    """Weights that minimise the mean logistic loss of better - worse plus a ridge, by Newton's method."""
    d = better - worse

    def sums(w: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
        return np.concatenate(([len(d)], -(d * p[:, None]).sum(axis=0), ((d * (p * (1 - p))[:, None]).T @ d).ravel()))

    return _newton(sums, d.shape[1], ridge, steps)


def pair_sums(good: np.ndarray, bad: np.ndarray, w: np.ndarray) -> np.ndarray:
    """What _newton needs of all pairs of a good and a bad row, without the pairs' differences."""
    p = 1 / (1 + np.exp(np.clip((good @ w)[:, None] - (bad @ w)[None, :], -500, 500)))
    h = p * (1 - p)
    cross = good.T @ h @ bad
    second = (good * h.sum(axis=1)[:, None]).T @ good + (bad * h.sum(axis=0)[:, None]).T @ bad - cross - cross.T
    return np.concatenate(([p.size], p.sum(axis=0) @ bad - p.sum(axis=1) @ good, second.ravel()))


def quantile(worth: np.ndarray, weight: np.ndarray, share: float) -> float:
    """Halfway between the worths around the point below which the given share of the weight lies."""
    order = np.argsort(worth, kind="stable")
    below = np.cumsum(weight[order]) / weight.sum()
    k = int(np.searchsorted(below, share + 1e-9))
    return float(worth[order][max(0, k - 1)] + worth[order][min(k, len(order) - 1)]) / 2


def fit(known: DataFrame, counts: dict[int, int], rate: float) -> Model:
    """known: doc_id, label, x (features), each labelled document once for each label; counts: its rows of each label; rate
    stands in where a label is missing.

    Rows of either label are ranked by their hashed ids and dealt to blocks in turn; rows of the rarer label go to several
    blocks where there are too few. A Newton step sums over the blocks' pairs in Spark, and the driver gets the sums of at
    most PARTS parts."""
    if not counts.get(0) or not counts.get(1):
        return Model(np.zeros(0), np.zeros(0), np.zeros(0), 0.0, rate)
    spark, n = known.sparkSession, counts[0] + counts[1]
    blocks = -(-max(counts.values()) // BLOCK)
    parts = min(PARTS, blocks)
    ranked = [known.filter(F.col("label") == k).sort(F.xxhash64("doc_id"), "doc_id").rdd.map(lambda r: (r["label"], r["doc_id"], bytes(r["x"]))).zipWithIndex() for k in (0, 1)]

    def deal(row: tuple) -> Iterator[tuple]:
        (label, doc_id, x), rank = row
        for i in range(rank, max(blocks, counts[label]), counts[label]):
            yield i % blocks, (label, rank, x, i == rank)

    def block(rows: Iterator[tuple]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of a part, in order: labels, features, and whether a row stands here for itself."""
        for key, found in groupby(sorted(rows), key=lambda r: r[0]):
            held = [r[1] for r in found]
            yield key, np.array([r[0] for r in held]), np.frombuffer(b"".join(r[2] for r in held), dtype="<f8").reshape(-1, len(NAMES)), np.array([r[3] for r in held])

    dealt = ranked[0].union(ranked[1]).flatMap(deal).partitionBy(parts, lambda k: k).mapPartitions(block, preservesPartitioning=True).persist(StorageLevel.MEMORY_AND_DISK)

    def total(of: Callable) -> np.ndarray:
        """The sum over all blocks, part by part in order, so that it is the same each time."""
        return sum(dealt.mapPartitions(lambda found: [sum((of(*b[1:]) for b in found), start=0.0)]).collect(), start=0.0)

    mean = total(lambda y, x, own: x[own].sum(axis=0)) / n
    spread = np.maximum(np.sqrt(total(lambda y, x, own: ((x[own] - mean) ** 2).sum(axis=0)) / n), 1e-6)

    def sums(w: np.ndarray) -> np.ndarray:
        def one(y: np.ndarray, x: np.ndarray, own: np.ndarray) -> np.ndarray:
            z = _spread(x, mean, spread)
            return pair_sums(z[y == 1], z[y == 0], w)

        return total(one)

    weights = _newton(sums, 3 * len(NAMES), RIDGE, 25)
    worth = dealt.flatMap(lambda b: (_spread(b[2][b[3]], mean, spread) @ weights).tolist()).sortBy(lambda v: v).zipWithIndex()
    around = np.array(worth.filter(lambda v: v[1] in (counts[0] - 1, counts[0])).keys().collect())
    dealt.unpersist()
    return Model(mean, spread, weights, quantile(around, np.ones(len(around)), 0.5), rate)


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = pa.array([features(t).astype("<f8").tobytes() for t in C.strings_of(batch)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), x], names=["doc_id", "x"])


def featured(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, x (features of its text, as little-endian doubles)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_features, "doc_id long, x binary")


def _known(labels: DataFrame, label: str) -> tuple[DataFrame, dict[int, int]]:
    """Labels to learn from (doc_id, label), and how many there are of each."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & (remainder(F.col("doc_id")) != 0))
    return known, {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}


def _learn(found: DataFrame, known: DataFrame, counts: dict[int, int]) -> Model:
    """found: as featured() gives it. Rows of a doc_id become one before they meet the labels, within tasks first."""
    found = found.filter(remainder(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.min("x").alias("x"))
    found = C.saved(found.join(known.distinct(), "doc_id").select("doc_id", "label", "x"), "labelled")
    return fit(found, {r["label"]: r["count"] for r in found.groupBy("label").count().collect()}, counts[1] / sum(counts.values()))


def _unlearned(counts: dict[int, int]) -> Model:
    return Model(np.zeros(0), np.zeros(0), np.zeros(0), 0.0, counts.get(1, 0) / sum(counts.values()) if counts else 0.5)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Fit on all labelled documents whose remainder isn't 0."""
    known, counts = _known(labels, label)
    if len(counts) < 2:
        return _unlearned(counts)
    return _learn(featured(docs.filter(remainder(F.col("doc_id").cast("long")) != 0)), known, counts)


def train_and_score(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """What score() gives by what train() learns, from features that are computed once and saved."""
    known, counts = _known(labels, label)
    if len(counts) < 2:
        return score(docs, _unlearned(counts))
    found = C.saved(featured(docs), "features")
    return _scored(found, _learn(found, known, counts), "x")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out (its remainder is 0), score, predicted (1 if score >= THRESHOLD)."""
    return _scored(docs.select("doc_id", F.col("text").cast("string").alias("text")), model, "text")


def _scored(docs: DataFrame, model: Model, given: str) -> DataFrame:
    """given: what scores are computed from, text or x."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), given)

    def scores(batch: pa.RecordBatch) -> np.ndarray:
        model = sent.value
        if given == "text":
            return model.scores(C.strings_of(batch))
        if not len(model.weights):
            return np.full(batch.num_rows, model.rate)
        return model.scores_of(np.frombuffer(b"".join(C.bytes_of(batch, "x")), dtype="<f8").reshape(-1, len(NAMES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scores(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found, pa.float64()), pa.array((found >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")

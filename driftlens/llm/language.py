"""Language identification by hierarchical discrimination.

Byte n-grams of the whole text are hashed into a unit vector. One-versus-one linear support vector machines first
choose the language family, then, inside it, the language. They are trained in numpy on the driver from a bounded
sample: about SAMPLE documents of each language, chosen by a hash of their id, sent as vectors.

Defined results: null text, or text without any letter, is und with score 0, and so is everything if nothing is
labelled; a language that no family lists is a family of its own; rows repeated each get a row; a null doc_id is
never learned from and isn't held out; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.llm import common as C

#: The bound of the training sample: documents of each language, about; and the number of features.
SAMPLE, FEATURES = 600, 4096
CHUNK = 1 << 20

# Families and their languages.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy", "romance": "fr es it pt ro ca gl oc", "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "baltic": "lt lv", "uralic": "fi et hu", "turkic": "tr az kk uz", "hellenic": "el", "semitic": "ar he mt", "indo-aryan": "hi bn ur mr gu pa",
    "iranian": "fa ku ps", "dravidian": "ta te kn ml", "sinitic": "zh yue", "japonic": "ja", "koreanic": "ko", "celtic": "ga cy gd br", "malayic": "id ms tl",
}
FAMILY = {language: family for family, languages in FAMILIES.items() for language in languages.split()}


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def vector(text: bytes) -> np.ndarray:
    """Square roots of hashed counts of 2 and 3 bytes, of length 1. The text is read in overlapping chunks."""
    data = np.frombuffer(b" " + text.lower() + b" ", dtype=np.uint8)
    counts = np.zeros(FEATURES)
    for at in range(0, max(len(data) - 2, 1), CHUNK):
        a = data[at : at + CHUNK + 2].astype(np.uint32)
        two = a[:-1] | a[1:] << np.uint32(8)
        three = two[:-1] | a[2:] << np.uint32(16)
        for code in (two[: len(three)], three | np.uint32(1 << 24)):
            counts += np.bincount(code * np.uint32(2654435761) >> np.uint32(20), minlength=FEATURES)
    found = np.sqrt(counts)
    return (found / max(np.linalg.norm(found), 1e-9)).astype(np.float32)


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 4.0, rounds: int = 150) -> np.ndarray:
    """Weights and, last, the bias of a linear machine with squared hinge loss, by accelerated gradient descent. y: 1 or -1."""
    x = np.hstack((x, np.ones((len(x), 1), dtype=np.float32)))
    c /= max(1, len(x)) / 100
    u = np.ones(x.shape[1], dtype=np.float32)
    for _ in range(15):  # the largest eigenvalue, for the step
        u = x.T @ (x @ (u / np.linalg.norm(u)))
    step = 1 / (1 + 2 * c * np.linalg.norm(u))
    w = ahead = np.zeros(x.shape[1], dtype=np.float32)
    for k in range(rounds):
        gap = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - step * (ahead - 2 * c * (x.T @ (y * gap)))
        w, ahead = new, new + k / (k + 3) * (new - w)
    return w


@dataclass
class Model:
    """Machines by pair of classes (families, or languages of one family); positive speaks for the first."""

    families: dict[str, list[str]]
    machines: dict[tuple[str, str], np.ndarray]

    def choose(self, classes: list[str], x: np.ndarray) -> tuple[str, float]:
        """The class with the most wins, then margin; how sure its duels were, 0 to 1."""
        if len(classes) == 1:
            return classes[0], 1.0
        wins, margin, sure = dict.fromkeys(classes, 0), dict.fromkeys(classes, 0.0), dict.fromkeys(classes, 1.0)
        for a, b in combinations(classes, 2):
            w = self.machines[a, b]
            m = float(w[:-1] @ x + w[-1])
            wins[a if m >= 0 else b] += 1
            margin[a] += m
            margin[b] -= m
            p = 1 / (1 + np.exp(-4 * m))
            sure[a], sure[b] = min(sure[a], p), min(sure[b], 1 - p)
        best = max(classes, key=lambda k: (wins[k], margin[k], k))
        return best, float(sure[best])

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        family, p = self.choose(list(self.families), x)
        language, q = self.choose(self.families[family], x)
        return language, min(1.0, max(0.0, p * q))


def fit(x: np.ndarray, languages: list[str]) -> Model | None:
    if not languages:
        return None
    label = np.array(languages)
    family = np.array([FAMILY.get(k, f"only {k}") for k in languages])
    families = {f: sorted(set(label[family == f])) for f in sorted(set(family))}
    machines = {}
    for classes, of in [(list(families), family), *((v, label) for v in families.values())]:
        for a, b in combinations(classes, 2):
            at = np.flatnonzero((of == a) | (of == b))
            machines[a, b] = train_svm(x[at], np.where(of[at] == a, 1, -1).astype(np.float32))
    return Model(families, machines)


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([vector(t).astype("<f2").tobytes() for t in C.bytes_of(batch)], pa.binary())], names=["lang", "x"])


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit on labelled documents whose remainder isn't 2, about sample of each language, twice as many at most (where
    ids repeat)."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id")) != 2))
    rates = labelled.groupBy("lang").count().select("lang", (F.lit(sample) / F.col("count") * (1 << 20)).alias("rate"))
    rates = C.saved(rates, "rates")  # a row for each language, so small enough to send
    most = 2 * sample * rates.count()
    chosen = labelled.join(F.broadcast(rates), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("rate"))
    rows = sorted((r["lang"], bytes(r["x"])) for r in chosen.select("lang", "text").mapInArrow(_vectors, "lang string, x binary").limit(most).collect())
    x = np.frombuffer(b"".join(v for _, v in rows), dtype="<f2").astype(np.float32).reshape(-1, FEATURES)
    return fit(x, [k for k, _ in rows])


def predictions(model: Model | None, batch: pa.RecordBatch) -> list[tuple[str, float]]:
    texts = batch.column("text").to_pylist()
    return [model.predict(vector(t.encode())) if model and t and has_letter(t) else ("und", 0.0) for t in texts]


def _predict(sent: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = sent.value
        for batch in batches:
            languages, scores = zip(*predictions(model, batch)) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(languages, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per document: doc_id, held_out (its remainder is 2), lang_pred, score."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs, all columns, whose language isn't und."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with C.task_memory():
            for batch in batches:
                yield batch.filter(pa.array([k != "und" for k, _ in predictions(sent.value, batch)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

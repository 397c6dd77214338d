"""Vector code compression: four small codebooks fitted by rounds of nearest entries and means, all in whole numbers.

A vector's components become floor(SCALE * x) and are cut into PARTS consecutive parts; a vector's code is the index of the
nearest codebook entry for each part. Vectors are first written as blocks, each a row with one NumPy row for each
component. In a round every block adds its distances component by component, np.add.at puts its parts into int64 sums
and counts for each entry, and an RDD treeAggregate merges those tensors, so that the driver gets a few of them,
whatever the number of vectors. Blocks are a table in the shared folder: a lost executor costs their reading again.

Defined results: a vector that is null or has a null or non-finite component (or one whose SCALE-fold isn't finite) is
dropped; the length of vectors is that of the kept vector with the smallest id, and vectors of other lengths are
dropped too; where it isn't a multiple of PARTS the first parts are one longer. Rows repeated each get a row; equal ids
are ordered by their components, null ids come last. Components too large for 64-bit sums or distances are computed as
Python integers, and an error of over 2**63 - 1 is given as that. Null labels are one label. An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlens.llm import common as C

ENTRIES, PARTS, ROUNDS, SCALE = 256, 4, 4, 1024
#: Components of a block, about.
BLOCK = 1 << 16
MOST = 2**63 - 1
#: Rows of one label are dealt to so many groups when its sum comes back to them.
SALT = 64


def cuts(dim: int) -> list[slice]:
    """The parts of a vector, as equal as can be."""
    wide, more = divmod(dim, PARTS)
    ends = np.cumsum([0] + [wide + (p < more) for p in range(PARTS)])
    return [slice(int(a), int(b)) for a, b in zip(ends, ends[1:])]


def whole(values: np.ndarray, kind: type) -> np.ndarray:
    """Whole-numbered values as kind; object stands for Python integers."""
    return np.frompyfunc(int, 1, 1)(values).astype(object) if kind is object else values.astype(kind)


def nearest(part: np.ndarray, book: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """For the vectors of part (a row for each component): the first of the nearest entries of book, and its squared distance."""
    distance = np.zeros((part.shape[1], len(book)), dtype=kind)
    for x, c in zip(whole(part, kind), whole(book.T, kind)):
        step = x[:, None] - c[None, :]
        distance += step * step
    codes = distance.argmin(axis=1) if len(distance) else np.zeros(0, dtype=np.int64)
    return codes, distance[np.arange(len(codes)), codes]


@dataclass
class Codebooks:
    """For each part its entries, and the kinds of number that hold distances and sums."""

    dim: int
    books: list[np.ndarray]
    distances: type
    sums: type

    def encode(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, a column for each part, and the errors of the vectors of a block."""
        found = [nearest(block[at], book, self.distances) for at, book in zip(cuts(self.dim), self.books)]
        total = sum(whole(d, object if self.distances is object else np.int64) for _, d in found)
        return np.stack([c for c, _ in found], axis=1), total

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for book in self.books for x in book.ravel()).encode()).hexdigest()


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, vector, label of the rows whose vectors hold finite components only."""
    fine: Callable[[Column], Column] = lambda x: x.isNotNull() & (F.abs(x) * SCALE < float("inf"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), "label")
    return rows.filter(F.col("vector").isNotNull() & F.forall("vector", fine))


def floors(vectors: pa.Array, dim: int) -> np.ndarray:
    """floor(SCALE * x) with a row for each component and a column for each vector."""
    flat = pc.list_flatten(vectors).to_numpy(zero_copy_only=False)
    return np.floor(flat.reshape(len(vectors), dim) * SCALE).T


def _blocks(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = max(1, BLOCK // max(1, dim))
        for batch in batches:
            for at in range(0, batch.num_rows, n):
                block = floors(batch.column("vector").slice(at, n), dim)
                most = float(np.abs(block).max(initial=0))
                kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
                yield pa.RecordBatch.from_pydict({"n": pa.array([block.shape[1]], pa.int64()), "most": [most], "kind": [kind], "data": [block.astype(kind).tobytes()]})

    return run


def _add(sent) -> Callable:
    def run(total: list | None, row: Row) -> list:
        codebooks: Codebooks = sent.value
        block = np.frombuffer(row["data"], dtype=row["kind"]).reshape(codebooks.dim, row["n"])
        if total is None:
            total = [(np.zeros(book.shape, dtype=codebooks.sums), np.zeros(len(book), dtype=np.int64)) for book in codebooks.books]
        for at, book, (sums, counts) in zip(cuts(codebooks.dim), codebooks.books, total):
            codes, _ = nearest(block[at], book, codebooks.distances)
            np.add.at(sums, codes, whole(block[at].T, codebooks.sums))
            np.add.at(counts, codes, 1)
        return total

    return run


def _merge(a: list | None, b: list | None) -> list | None:
    if a is None or b is None:
        return b if a is None else a
    return [(s + t, n + m) for (s, n), (t, m) in zip(a, b)]


def train(rows: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of the rows of usable(); None where there are none."""
    spark = rows.sparkSession
    order = (F.asc_nulls_last("vec_id"), F.col("vector"))
    one = rows.orderBy(*order).limit(1).collect()
    if not one:
        return None
    dim = len(one[0]["vector"])
    rows = rows.filter(F.size("vector") == dim)
    first = rows.orderBy(*order).limit(entries).collect()
    first = np.floor(np.array([r["vector"] for r in first], dtype=np.float64).reshape(len(first), dim) * SCALE)
    blocks = C.saved(rows.select("vector").mapInArrow(_blocks(dim), "n long, most double, kind string, data binary"), "blocks")
    most, n = (int(x) for x in blocks.agg(F.max("most"), F.sum("n")).first())
    farthest = max(1, -(-dim // PARTS)) * (2 * most) ** 2
    distances = np.int32 if farthest < 2**31 else np.int64 if PARTS * farthest < 2**63 else object
    sums = np.int64 if most * n < 2**63 else object
    codebooks = Codebooks(dim, [whole(first[:, at], sums) for at in cuts(dim)], distances, sums)
    data = blocks.select("n", "kind", "data").rdd
    depth = 2 if data.getNumPartitions() < 1000 else 3
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(codebooks)  # entries x dim numbers
        total = data.treeAggregate(None, _add(sent), _merge, depth)
        books = [np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], book) for (sums, counts), book in zip(total, codebooks.books)]
        codebooks = Codebooks(dim, books, distances, sums)
        sent.destroy()
    return codebooks


def encode(rows: DataFrame, codebooks: Codebooks) -> DataFrame:
    """vec_id, label, code (two hex digits for each part), error of the rows of usable() whose length fits."""
    sent = rows.sparkSession.sparkContext.broadcast(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = max(1, BLOCK // max(1, codebooks.dim))
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, n):
                batch = whole_batch.slice(at, n)
                codes, errors = sent.value.encode(floors(batch.column("vector"), sent.value.dim))
                names = pa.array([bytes(row).hex() for row in codes.astype(np.uint8)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), names, pa.array([min(int(e), MOST) for e in errors], pa.int64())], names=["vec_id", "label", "code", "error"])

    schema = T.StructType([*rows.select("vec_id", "label").schema.fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return rows.filter(F.size("vector") == codebooks.dim).mapInArrow(run, schema)


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds label_error, the error summed over equal labels. A label may hold any share of the rows: they meet its sum by salt."""
    sums = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    sums = sums.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("at"))
    dealt = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALT)).cast("int"))
    return dealt.join(sums, dealt["label"].eqNullSafe(sums["of"]) & (dealt["salt"] == sums["at"])).select(*coded.columns, "label_error")


def compress(embeddings: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """A row for each usable vector (vec_id, label, code, error, label_error), and the codebooks."""
    rows = usable(embeddings)
    codebooks = train(rows, entries, rounds)
    if codebooks is None:
        return rows.filter("false").select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), None
    return with_label_errors(C.saved(encode(rows, codebooks), "codes")), codebooks

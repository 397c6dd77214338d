"""Exact deduplication by a log-structured merge index.

Each task fills a memtable keyed by digest and flushes it as a run: one row per digest bucket with the sorted
digests, the documents behind each, and a Bloom filter. Compaction brings the runs of a bucket together; the
filters let digests that no other run can hold pass straight through, the rest are merged, and the document to
keep of each digest is chosen. Inside a run, bytes are compared when a digest is hit; for hits between runs the
representatives' bytes are compared afterwards, and a digest that stands for several texts is regrouped by text.

Defined results: null text is empty; rows repeated with the same id each get a row and only one is kept; a null
doc_id is smaller than any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftlens.llm import common as C

#: A memtable is flushed at this many bytes of text or documents; documents whose digests are merged in one task, about.
MEMTABLE_BYTES, MEMTABLE_ROWS, BUCKET_ROWS = 64 << 20, 1 << 20, 1 << 20

RUN = "run long, bucket int, digests binary, starts binary, ids binary, keeps binary, sizes binary, filter binary"
MERGED = "run long, bucket int, keep binary, size binary, mine binary, entries binary"
RESULT = "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string"
RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("kept", pa.bool_()), ("text_sha256", pa.string())])
#: Rows up to which the ids of representatives are sent to every executor; beyond, they are joined by shuffle.
BROADCAST_ROWS = 200_000


def sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def _words(digests: np.ndarray) -> np.ndarray:
    """Two words of each digest for bucket and filter positions."""
    return digests.reshape(-1, 32)[:, :16].copy().view("<u8").reshape(-1, 2)


def _filter(words: np.ndarray) -> bytes:
    """A Bloom filter with a power of two of bits, about 16 a digest, two probes."""
    bits = np.zeros(max(64, 1 << int(16 * max(len(words), 1) - 1).bit_length()), dtype=bool)
    for k in (0, 1):
        bits[(words[:, k] & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def flush(table: dict[bytes, list[tuple[bytes, list[int]]]], run: int, n_buckets: int) -> Iterator[pa.RecordBatch]:
    """The rows of one run."""
    entries = sorted((d, ids) for d, texts in table.items() for _, ids in texts)
    digests = np.frombuffer(b"".join(d for d, _ in entries), dtype=np.uint8).reshape(-1, 32)
    words = _words(digests)
    bucket = (words[:, 1] >> np.uint64(20)) % np.uint64(n_buckets)
    rows = []
    for b in np.unique(bucket):
        at = np.flatnonzero(bucket == b)
        own = [np.array(entries[i][1], dtype="<i8") for i in at]
        rows.append({
            "run": run, "bucket": int(b), "digests": digests[at].tobytes(), "ids": np.concatenate(own).tobytes(),
            "starts": np.cumsum([0, *map(len, own)], dtype="<i8").tobytes(),
            "keeps": np.array([x.max() for x in own], dtype="<i8").tobytes(),
            "sizes": np.array([len(x) for x in own], dtype="<i8").tobytes(), "filter": _filter(words[at]),
        })
    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("run", pa.int64()), ("bucket", pa.int32())] + [(c, pa.binary()) for c in ("digests", "starts", "ids", "keeps", "sizes", "filter")]))


def memtables(n_buckets: int, digest: Callable[[bytes], bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, k = TaskContext.get().partitionId() << 24, 0
        table: dict = {}
        held = rows = 0
        for batch in batches:
            for doc_id, text in zip(C.ids_of(batch).tolist(), C.bytes_of(batch)):
                text = text.lower()  # bytes: A-Z only
                key = digest(text)
                known = table.setdefault(key, [])
                for other, ids in known:
                    if other == text:
                        ids.append(doc_id)
                        break
                else:
                    known.append((text, [doc_id]))
                    held += len(text)
                rows += 1
                if held > MEMTABLE_BYTES or rows >= MEMTABLE_ROWS:
                    yield from flush(table, first + k, n_buckets)
                    table, held, rows, k = {}, 0, 0, k + 1
        if table:
            yield from flush(table, first + k, n_buckets)

    return run


def merged_order(key: np.ndarray, last: np.ndarray, run: np.ndarray) -> np.ndarray:
    """The order of digests (four words each) of sorted runs that follow one another; of one digest the least last, then
    run, comes first. A stable sort merges runs; what agrees in the first word is put in order by the rest."""
    order = np.argsort(key[:, 0], kind="stable")
    first = key[order, 0]
    tied = np.zeros(len(order), dtype=bool)
    tied[1:] = first[1:] == first[:-1]
    tied[:-1] |= tied[1:]
    at = np.flatnonzero(tied)
    part = order[at]
    order[at] = part[np.lexsort((run[part], last[part], key[part, 3], key[part, 2], key[part, 1], key[part, 0]))]
    return order


def compact(runs: pd.DataFrame) -> pd.DataFrame:
    """Merge the runs of one bucket: for each entry of each run, what its digest's group keeps."""
    digests = [np.frombuffer(d, dtype=np.uint8).reshape(-1, 32) for d in runs["digests"]]
    owner = np.repeat(np.arange(len(digests)), [len(d) for d in digests])
    every = np.concatenate(digests)
    keeps = np.concatenate([np.frombuffer(x, dtype="<i8") for x in runs["keeps"]])
    sizes = np.concatenate([np.frombuffer(x, dtype="<i8") for x in runs["sizes"]])
    run = runs["run"].to_numpy()[owner]

    filters = [np.unpackbits(np.frombuffer(f, dtype=np.uint8), bitorder="little") for f in runs["filter"]]
    n = max(map(len, filters))
    shared = np.zeros(n, dtype=np.int32)
    for f in filters:  # a smaller filter repeats itself in a larger one
        shared += np.tile(f, n // len(f))
    at = (_words(every) & np.uint64(n - 1)).astype(np.int64)
    again = np.zeros(len(every), dtype=bool)  # one digest twice in a run: its bytes differed there
    again[1:] = (owner[1:] == owner[:-1]) & (every[1:] == every[:-1]).all(axis=1)
    again[:-1] |= again[1:]
    possible = np.flatnonzero((shared[at].min(axis=1) > 1) | again)

    keep, size, mine, entries = keeps.copy(), sizes.copy(), np.ones(len(every), dtype=bool), np.ones(len(every), dtype=np.int64)
    if len(possible):
        order = possible[merged_order(every[possible].copy().view(">u8").astype(np.uint64).reshape(-1, 4), ~keeps[possible], run[possible])]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (every[order][1:] != every[order][:-1]).any(axis=1)
        start, group = np.flatnonzero(new), np.cumsum(new) - 1
        keep[order] = keeps[order[start]][group]
        size[order] = np.add.reduceat(sizes[order], start)[group]
        entries[order] = np.diff(np.append(start, len(order)))[group]
        mine[order] = new
    bounds = np.cumsum([0, *map(len, digests)])
    part = lambda x: [x[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
    return pd.DataFrame({"run": runs["run"], "bucket": runs["bucket"], "keep": part(keep), "size": part(size), "mine": part(mine), "entries": part(entries)})


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document of each run."""
    for batch in batches:
        for r in batch.to_pylist():
            starts, ids = np.frombuffer(r["starts"], dtype="<i8"), np.frombuffer(r["ids"], dtype="<i8")
            entry = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            keep = np.frombuffer(r["keep"], dtype="<i8")[entry]
            kept = np.frombuffer(r["mine"], dtype=bool)[entry] & (ids == keep)
            at = np.flatnonzero(kept)
            kept[at[1:][entry[at[1:]] == entry[at[:-1]]]] = False  # the row repeated
            hexed = [r["digests"][i : i + 32].hex() for i in range(0, len(r["digests"]), 32)]
            yield pa.RecordBatch.from_arrays([C.id_array(ids), C.id_array(keep), pa.array(np.frombuffer(r["size"], dtype="<i8")[entry]), pa.array(kept), pa.array([hexed[i] for i in entry.tolist()], pa.string())], schema=RESULT_ARROW)


def _representatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One document of each entry whose digest is in several entries."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary())])
    for batch in batches:
        for r in batch.to_pylist():
            keeps, at = np.frombuffer(r["keeps"], dtype="<i8"), np.flatnonzero(np.frombuffer(r["entries"], dtype="<i8") > 1)
            yield pa.RecordBatch.from_arrays([C.id_array(keeps[at]), pa.array([r["digests"][32 * i : 32 * i + 32] for i in at.tolist()], pa.binary())], schema=schema)


def _digested(digest: Callable[[bytes], bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.lower() for t in C.bytes_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([digest(t) for t in texts], pa.binary()), pa.array(texts, pa.binary())], names=["doc_id", "digest", "norm"])

    return run


def verify(docs: DataFrame, representatives: DataFrame, digest: Callable[[bytes], bytes]) -> DataFrame:
    """Digests that stand for more than one text among the representatives: bytes are compared, never digests alone."""
    ids = representatives.select("doc_id").distinct()
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    found = docs.join(F.broadcast(ids) if few else ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    texts = found.mapInArrow(_digested(digest), "doc_id long, digest binary, norm binary")
    return texts.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b")).filter("a <> b").select("digest")


def exact_dedup(docs: DataFrame, digest: Callable[[bytes], bytes] = sha256, n_buckets: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (the digest in hexadecimal).

    Texts are equal when identical after lower-casing A-Z; of equal texts the row with the largest doc_id stays.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n_buckets = n_buckets or max(C.partitions(docs.sparkSession), docs.count() // BUCKET_ROWS)
    runs = C.saved(docs.mapInArrow(memtables(n_buckets, digest), RUN), "runs")
    merged = C.saved(runs.select("run", "bucket", "digests", "keeps", "sizes", "filter").groupBy("bucket").applyInPandas(compact, MERGED), "merged")
    entries = runs.select("run", "bucket", "digests", "keeps").join(merged.select("run", "bucket", "entries"), ["run", "bucket"]).mapInArrow(_representatives, "doc_id long, digest binary")
    entries = C.saved(entries, "representatives")
    collided = C.saved(verify(docs, entries, digest), "collided")
    result = runs.select("run", "bucket", "digests", "starts", "ids").join(merged, ["run", "bucket"]).mapInArrow(_expand, RESULT)
    if collided.isEmpty():
        return result
    hexed = collided.select(F.lower(F.hex("digest")).alias("text_sha256"))
    texts = docs.mapInArrow(_digested(digest), "doc_id long, digest binary, norm binary").join(collided, "digest", "left_semi")
    group = W.partitionBy("digest", "norm")
    again = texts.select(
        "doc_id", F.max("doc_id").over(group).alias("keep_id"), F.count("*").over(group).alias("group_size"),
        (F.row_number().over(group.orderBy(F.desc("doc_id"))) == 1).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
    return result.join(hexed, "text_sha256", "left_anti").select(again.columns).unionByName(again)

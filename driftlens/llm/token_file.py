"""Token-id files in Simple-8b coding.

A file set is a folder of segments (one row each, in a Parquet container, so that any store and Spark's commit
protocol serve it). A segment holds the ids of consecutive documents as 64-bit little-endian words: the top 4 bits
select how the other 60 are cut. Ids are coded in blocks of 256, each starting on a word of its own, whose offsets
are stored: a reader decodes all blocks at once, or just those it wants.

Selectors: 0: the next word is one raw 64-bit id (escape); 1: 120 zeros, or the end of a block;
2 to 15: 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2 or 1 ids of 60 // count bits.

Defined results: null or empty text is the end id alone; rows are in ascending doc_id, null first, rows of one id in
the order of their text's hash; an empty table gives an empty file set; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftlens.llm import common as C
from driftlens.llm.tokens import encoder, portions

BLOCK = 256
#: Ids in a segment, about; a document is never split.
SEGMENT_IDS = 1 << 19
#: Words that a worker remembers, some 240 MB: the file's writer shares its workers with no other stage.
REMEMBERED = 1_000_000
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([64, 0, *(60 // COUNTS[2:])])

SEGMENTS = "shard long, segment long, first long, n_ids long, doc_ids binary, lengths binary, offsets binary, words binary"
SEGMENTS_ARROW = pa.schema([(c, pa.int64()) for c in ("shard", "segment", "first", "n_ids")] + [(c, pa.binary()) for c in ("doc_ids", "lengths", "offsets", "words")])


#: How the widest of k values is found from two overlapping shorter runs: k, the shorter run, the second one's place.
RUNS = [(2, 1, 1), (3, 2, 1), (4, 2, 2), (5, 4, 1), (6, 3, 3), (7, 4, 3), (8, 4, 4), (10, 5, 5), (12, 6, 6), (15, 8, 7), (20, 10, 10), (30, 15, 15), (60, 30, 30)]


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs: the exponent of its upper or lower half, which a float holds exactly."""
    upper = values >> np.uint64(32)
    if not upper.any():
        return np.frexp(values.astype(np.float64))[1].astype(np.int8)
    lower = np.frexp((values & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    return np.where(upper > 0, 32 + np.frexp(upper.astype(np.float64))[1], lower).astype(np.int8)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and the first word of each block. All blocks choose their words a step at a time together; the words of
    one selector are then packed at once."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return np.zeros(0, dtype="<u8"), np.zeros(0, dtype="<u4")
    values = np.zeros((n, BLOCK + 128), dtype=np.uint64)
    flat = np.zeros(n * BLOCK, dtype=np.uint64)
    flat[: len(ids)] = ids
    values[:, :BLOCK] = flat.reshape(n, BLOCK)
    size = np.full(n, BLOCK)
    size[-1] = len(ids) - (n - 1) * BLOCK
    wide = {1: np.zeros(values.shape, dtype=np.int8)}  # the widest of the next k values
    wide[1][:, :BLOCK] = _bits(flat).reshape(n, BLOCK)
    for k, shorter, second in RUNS:
        wide[k] = wide[shorter].copy()
        np.maximum(wide[shorter][:, :-second], wide[shorter][:, second:], out=wide[k][:, :-second])
    selector = np.zeros((n, BLOCK), dtype=np.int8)  # to use at each position
    for s in range(15, 1, -1):
        selector[wide[COUNTS[s]][:, :BLOCK] <= BITS[s]] = s
    zero = wide[60] == 0
    selector[zero[:, :BLOCK] & zero[:, 60 : 60 + BLOCK]] = 1
    at, row, rows, places = np.zeros(n, dtype=np.int64), np.arange(n), [], []
    while len(row):
        rows.append(row)
        places.append(at)
        at = at + COUNTS[selector[row, at]]
        held = at < size[row]
        row, at = row[held], at[held]
    row, at = np.concatenate(rows), np.concatenate(places)
    order = np.argsort(row, kind="stable")
    row, at = row[order], at[order]
    chosen = selector[row, at]
    word = chosen.astype(np.uint64) << np.uint64(60)
    for s in range(2, 16):
        here = np.flatnonzero(chosen == s)
        for j in range(COUNTS[s] if len(here) else 0):
            word[here] |= values[row[here], at[here] + j] << np.uint64(BITS[s] * j)
    raw = chosen == 0
    place = np.cumsum(1 + raw) - 1 - raw
    words = np.zeros(len(word) + int(raw.sum()), dtype="<u8")
    words[place], words[place[raw] + 1] = word, values[row[raw], at[raw]]
    return words, place[np.searchsorted(row, np.arange(n))].astype("<u4")


def decode(words: np.ndarray, offsets: np.ndarray, n_ids: int) -> np.ndarray:
    """The ids of all blocks; each selector is decoded for all words at once."""
    if not n_ids:
        return np.zeros(0, dtype=np.uint64)
    ends = np.append(offsets[1:], len(words)).astype(np.int64)
    block = np.repeat(np.arange(len(offsets)), ends - offsets)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), dtype=bool)
    if (selector == 0).any():  # the word after an escape has no selector; escapes may follow one another
        i, zero = -1, set(np.flatnonzero(selector == 0).tolist())
        for i in sorted(zero):
            if not raw[i] and i + 1 < len(words):
                raw[i + 1] = True
    count = np.where(raw, 0, COUNTS[selector])
    where = np.cumsum(count) - count
    first = where[offsets.astype(np.int64)]
    out = np.zeros((len(offsets), BLOCK + 128), dtype=np.uint64)
    start = where - first[block]
    payload = words & np.uint64((1 << 60) - 1)
    for s in np.unique(selector[~raw]):
        at = np.flatnonzero((selector == s) & ~raw)
        if s == 0:
            out[block[at], start[at]] = words[at + 1]
        elif s >= 2:
            width, mask = np.uint64(BITS[s]), np.uint64((1 << int(BITS[s])) - 1)
            for j in range(COUNTS[s]):
                out[block[at], start[at] + j] = payload[at] >> (width * np.uint64(j)) & mask
    return out[:, :BLOCK].reshape(-1)[:n_ids]


def _segments(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = encoder(path, REMEMBERED), np.array([end_id], dtype="<u4").tobytes()
        shard, count, first = TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int] = []
        parts: list[bytes] = []
        held = 0

        def flush():
            ids = np.frombuffer(b"".join(parts), dtype="<u4")
            words, offsets = encode(ids.astype(np.uint64))
            row = {"shard": shard, "segment": count, "first": first, "n_ids": len(ids), "doc_ids": np.array(doc_ids, dtype="<i8").tobytes(), "lengths": np.array([len(p) // 4 for p in parts], dtype="<i8").tobytes(), "offsets": offsets.tobytes(), "words": words.tobytes()}
            return pa.RecordBatch.from_pylist([row], schema=SEGMENTS_ARROW)

        for batch in batches:
            ids, texts = C.ids_of(batch).tolist(), C.strings_of(batch)
            for a, b in portions(texts):
                for doc_id, data in zip(ids[a:b], tokenizer.ids(texts[a:b])):
                    doc_ids.append(doc_id)
                    parts.append(data + end)
                    held += len(data) // 4 + 1
                    if held >= SEGMENT_IDS:
                        yield flush()
                        doc_ids, parts, held, count, first = [], [], 0, count + 1, first + held
        if doc_ids:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0) -> None:
    """Tokenize whole texts and write them in ascending doc_id order: shards are ranges of doc_id, then of a hash of the text
    and of the part of the table that a row was read from, so that the rows of one id, or one row repeated, fill no shard alone."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.asc_nulls_first("doc_id"), F.col("hash"), F.col("part")]
    dealt = docs.withColumns({"hash": F.xxhash64("text"), "part": F.spark_partition_id()}).repartitionByRange(C.partitions(docs.sparkSession), *order)
    ordered = dealt.sortWithinPartitions(*order).select("doc_id", "text")
    ordered.mapInArrow(_segments(tokenizer_path, end_id), SEGMENTS).write.option("compression", "none").parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("shard", pa.int64()), ("doc_id", pa.int64()), ("within", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            ids = decode(np.frombuffer(r["words"], dtype="<u8"), np.frombuffer(r["offsets"], dtype="<u4"), r["n_ids"]).astype("<u4")
            lengths = np.frombuffer(r["lengths"], dtype="<i8")
            ends = np.cumsum(lengths)
            data = ids.tobytes()
            n = len(lengths)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r["shard"])), C.id_array(np.frombuffer(r["doc_ids"], dtype="<i8")), pa.array(r["first"] + ends - lengths), pa.array(lengths), pa.array([data[4 * a : 4 * b] for a, b in zip((ends - lengths).tolist(), ends.tolist())], pa.binary())], schema=schema)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned
    32-bit). What stands before each shard comes from the shards' counts: a row for each shuffle partition of the
    writer, so its broadcast doesn't grow with the data."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shards.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("before"))
    docs = segments.mapInArrow(_documents, "shard long, doc_id long, within long, n_tokens long, ids binary")
    return docs.join(F.broadcast(before), "shard").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids")

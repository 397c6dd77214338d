"""Removal of repeated passages, judged by longest-previous-factor arrays.

Every byte covered by a 200-byte string that also starts elsewhere is removed. Documents are cut into segments by
minimizers: of the 32-byte grams in a 200-byte window the one with the smallest hash is its anchor, and neighbouring
windows with one anchor are a segment. Equal 200-byte strings have equal anchors at equal places, so only segments
under one anchor have to meet. They are counted by anchor first (a partial sum before any shuffle):

* an anchor that stands once: none of its windows repeats;
* an anchor whose segments are all the same: all of its windows repeat;
* otherwise the different segments' bytes are brought together by anchor, their windows are put into suffix order
  (by their 200 bytes, then position), and from the previous and next smaller positions in it the longest previous
  factor of each window: one that reaches 200 bytes is a later copy of an earlier string, and both are marked.

An anchor with more than HOT different segments (a common phrase) isn't brought together: each window of its segments
is counted by a 128-bit hash instead, which Spark adds up before and after the shuffle, so no task holds them all.
Segments and anchors are compared by 64-bit hashes together with each other, rows named by doc_id and a 64-bit hash of
the text; the windows of differing segments by their bytes (of hot anchors by the 128-bit hash).

Defined results: null or short text is kept whole; rows repeated (same id and text) are copies of each other and
each get a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm import common as C

LENGTH, GRAM = 200, 32
#: Bytes hashed at a time, bytes of segments whose windows are sorted at a time, and rows of segments in a batch.
CHUNK, SORTED, ROWS = 1 << 16, 1 << 20, 20_000
#: Different segments under one anchor that are compared in one task: what is sorted at a time.
HOT = SORTED // 256

BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_tables: dict[str, np.ndarray] = {}


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ h >> np.uint64(30)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ h >> np.uint64(27)
    return h * np.uint64(0x94D049BB133111EB) ^ h >> np.uint64(31)


def segments(pieces: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Number of the piece, anchor hash, segment hash, first window and number of windows of each segment of some
    pieces (CHUNK + length bytes of them at most), which are hashed together."""
    data, w = np.frombuffer(b"".join(pieces), dtype=np.uint8), length - gram + 1
    if len(_tables.get("up", ())) < CHUNK + length + 1:
        _tables.update(up=_powers(BASE, CHUNK + length + 1), down=_powers(INVERSE, CHUNK + length + 1))
    up, down, n = _tables["up"], _tables["down"], len(data) - length + 1  # windows, those over a piece's end too
    ends = np.cumsum([len(p) for p in pieces])
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)))
    grams = _mixed((sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1])
    key = grams & ~np.uint64(0x1FFFF) | np.arange(len(grams), dtype=np.uint64)  # least hash, then leftmost
    padded = np.full(-(-len(key) // w) * w, np.uint64(2**64 - 1))
    padded[: len(key)] = key
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    anchor = (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & np.uint64(0x1FFFF)).astype(np.int64)
    edge = np.concatenate(([True], anchor[1:] != anchor[:-1]))
    begins = np.concatenate(([0], ends[:-1]))
    edge[begins[begins < n]] = True
    last = np.maximum(ends - length + 1, begins)  # the first windows that lie over a piece's end
    edge[last[last < n]] = True
    start = np.flatnonzero(edge)
    piece = np.searchsorted(ends, start, side="right")
    count = np.diff(np.append(start, n))
    inside = start < last[piece]
    start, piece, count = start[inside], piece[inside], count[inside]
    own = anchor[start]
    whole = (sums[start + count + length - 1] - sums[start]) * down[start]
    shape = (own - start).astype(np.uint64) << np.uint64(20) | count.astype(np.uint64)
    return piece, grams[own], _mixed(whole ^ _mixed(shape)), start - begins[piece], count


def portions(texts: list[bytes], length: int = LENGTH) -> Iterator[list[tuple[int, int, bytes]]]:
    """Pieces (text, first byte, bytes) that hold every window once, together of CHUNK + length bytes at most."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, CHUNK):
            piece = text[at : at + CHUNK + length - 1]
            if size + len(piece) > CHUNK + length and held:
                yield held
                held, size = [], 0
            held.append((i, at, piece))
            size += len(piece)
    if held:
        yield held


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, names = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("id", "row"))
        for part in portions(C.bytes_of(batch)):
            piece, anchor, seg, start, count = segments([p for *_, p in part])
            text, at = np.array([i for i, *_ in part])[piece], np.array([a for _, a, _ in part])[piece]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[text], names[text], anchor.view(np.int64), seg.view(np.int64), start + at, count.astype(np.int32))], names=["id", "row", "anchor", "seg", "start", "n"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fewer, larger batches."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= ROWS:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def suffix_order(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of some bytes that begin at starts, in the order of their first length bytes, then of position
    (as numbers of starts); and, along it, a number for each different string of length bytes."""
    windows = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(-length % 8, np.uint8)), length + -length % 8)[starts].copy()
    windows[:, length:] = 0
    order = np.argsort(windows.view(f"S{windows.shape[1]}").reshape(-1), kind="stable")
    words = windows.view(np.uint64)[order]
    return order, np.cumsum(np.concatenate(([0], (words[1:] != words[:-1]).any(axis=1))))


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """Index of the previous smaller value, -1 if none, by pointer jumping."""
    at = np.arange(len(values)) - 1
    open_ = np.flatnonzero((at >= 0) & (values[at] > values))
    while len(open_):
        at[open_] = at[at[open_]]
        open_ = open_[(at[open_] >= 0) & (values[at[open_]] > values[open_])]
    return at


def longest_previous_factor(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For each of the ascending starts the length, up to length, of the longest string that begins there and also
    at an earlier start, and of the longest that also begins at a later one. The candidates are the nearest smaller
    (larger) positions on either side in suffix order. whole: strings shorter than length count as 0."""
    order, number = suffix_order(data, starts, length)
    n = len(order)

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if whole:
            return length * (number[a] == number[b])
        differ = np.stack([data[starts[order[a]] + k] != data[starts[order[b]] + k] for k in range(length)] + [np.ones(len(a), bool)])
        return differ.argmax(axis=0)

    def best(values: np.ndarray) -> np.ndarray:
        found = np.zeros(n, dtype=np.int64)
        for near in (nearest_smaller(values), n - 1 - nearest_smaller(values[::-1])[::-1]):
            held = np.flatnonzero((near >= 0) & (near < n))
            found[order[held]] = np.maximum(found[order[held]], common(held, near[held]))
        return found

    return best(order), best(n - 1 - order)


def repeated(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each part, which of its windows of length also stand in another place of the parts (of whatever group:
    equal windows have equal anchors)."""
    n = np.array([len(p) - length + 1 for p in parts])
    upto = np.cumsum(n)
    starts = np.arange(upto[-1]) + np.repeat(np.arange(len(parts)) * (length - 1), n)
    before, after = longest_previous_factor(np.frombuffer(b"".join(parts), dtype=np.uint8), starts, length, whole=True)
    return np.split((before >= length) | (after >= length), upto[:-1])


def runs(hit: np.ndarray) -> np.ndarray:
    """First and last index of each run of true values, flat."""
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return np.stack((np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1), axis=1).reshape(-1).astype("<i4")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by anchor: whole anchors together until enough bytes are held. Hits of segments that stand once."""
    held: list[tuple[int, int, int, bytes]] = []
    size = 0

    def result():
        hits = repeated([d for *_, d in held])
        rows = [(a, s, r.tobytes()) for (a, s, c, _), hit in zip(held, hits) if c == 1 and len(r := runs(hit))]
        columns = list(zip(*rows)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], names=["anchor", "seg", "hits"])

    for batch in batches:
        for a, s, c, d in zip(*(batch.column(k).to_pylist() for k in ("anchor", "seg", "c", "data"))):
            if size >= SORTED and held[-1][0] != a:
                yield result()
                held, size = [], 0
            held.append((a, s, c, d))
            size += len(d)
    if held:
        yield result()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the segments that have to be compared."""

    def cut():
        for batch in batches:
            for i, text in enumerate(C.bytes_of(batch)):
                found = batch.column("segs")[i].values
                start, n = found.field("start").to_numpy(), found.field("n").to_numpy()
                data = [text[a:b] for a, b in zip(start.tolist(), (start + n + LENGTH - 1).tolist())]
                yield pa.RecordBatch.from_arrays([*(found.field(k) for k in ("anchor", "seg", "c", "hot")), pa.array(data, pa.binary())], names=["anchor", "seg", "c", "hot", "data"])

    yield from _joined(cut())


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of segments: its number and hash."""
    digest = xxhash.xxh3_128_digest
    for batch in batches:
        for a, s, c, d in zip(*(batch.column(k).to_pylist() for k in ("anchor", "seg", "c", "data"))):
            n = len(d) - LENGTH + 1
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, a)), pa.array(np.full(n, s)), pa.array(np.full(n, c)), pa.array(np.arange(n, dtype=np.int32)), pa.array([digest(d[k : k + LENGTH]) for k in range(n)], pa.binary())], names=["anchor", "seg", "c", "k", "hash"])


def _as_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of window numbers as runs."""
    for batch in batches:
        found = []
        for at in batch.column("at"):
            hit = np.zeros(max(k := at.values.to_numpy()) + 1, dtype=bool)
            hit[k] = True
            found.append(runs(hit).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("anchor"), batch.column("seg"), pa.array(found, pa.binary())], names=["anchor", "seg", "hits"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, found in zip(C.bytes_of(batch), batch.column("found")):
            n = len(text)
            edge = np.zeros(n + 1, dtype=np.int64)
            if found.is_valid:
                starts, hits = found.values.field("start").to_pylist(), found.values.field("hits").to_pylist()
                pairs = np.concatenate([np.frombuffer(h, dtype="<i4").astype(np.int64) + s for s, h in zip(starts, hits)]).reshape(-1, 2)
                np.add.at(edge, pairs[:, 0], 1)
                np.add.at(edge, pairs[:, 1] + LENGTH, -1)
            gone = np.cumsum(edge[:-1]) > 0
            spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0]) if n else 0
            removed = int(gone.sum())
            kept = text if not removed else np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
            rows.append((n, removed, spans, hashlib.sha256(kept).hexdigest(), kept))
        columns = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    named = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(C.NULL_ID)).alias("id"), F.xxhash64("text").alias("row"))
    name, segment, n_parts = ["id", "row"], ["anchor", "seg"], C.partitions(docs.sparkSession)
    # tables are saved before joins: a join that reads its own aggregate's partitions can't be split where a key is hot
    segs = named.select(*name, "text").mapInArrow(lambda b: _joined(_segments(b)), "id long, row long, anchor long, seg long, start long, n int")
    segs = C.saved(segs, "segments")
    counts = C.saved(segs.groupBy("anchor").agg(F.count("*").alias("c"), F.min("seg").alias("a"), F.max("seg").alias("b")).filter("c > 1"), "anchors")
    flagged = C.saved(segs.join(counts.select("anchor", (F.col("a") != F.col("b")).alias("mixed")), "anchor"), "flagged")

    # different segments under one anchor: each once (any place of it serves), with how often it stands
    one = [F.first(k).alias(k) for k in (*name, "start", "n")]
    kinds = C.saved(flagged.filter("mixed").groupBy(segment).agg(F.count("*").alias("c"), *one), "kinds")
    hot = C.saved(kinds.groupBy("anchor").count().filter(F.col("count") > HOT).select("anchor", F.lit(True).alias("hot")), "hot")
    kinds = kinds.join(hot, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    wanted = kinds.groupBy(name).agg(F.collect_list(F.struct(*segment, "c", "hot", "start", "n")).alias("segs"))
    cut = lambda rows: rows.join(wanted, name).select("text", "segs").mapInArrow(_cut, "anchor long, seg long, c long, hot boolean, data binary")
    whole = C.saved(named.groupBy(name).count().filter("count > 1").select(*name), "whole")  # rows that are repeated whole share a name
    once = cut(named if whole.isEmpty() else named.join(whole, name, "left_anti"))
    data = C.saved(once if whole.isEmpty() else once.unionByName(cut(named.join(whole, name, "left_semi")).dropDuplicates(segment)), "cut")

    few = data.filter("NOT hot").drop("hot").repartition(n_parts, "anchor").sortWithinPartitions("anchor")
    compared = few.mapInArrow(_compare, "anchor long, seg long, hits binary")
    windows = C.saved(data.filter("hot").drop("hot").mapInArrow(lambda b: _joined(_windows(b)), "anchor long, seg long, c long, k int, hash binary"), "windows")
    twice = C.saved(windows.groupBy("hash").count().filter(F.col("count") > 1).select("hash"), "twice")
    counted = windows.filter("c = 1").join(twice, "hash").groupBy(segment).agg(F.collect_list("k").alias("at")).mapInArrow(_as_runs, "anchor long, seg long, hits binary")
    often = kinds.filter("c > 1").select(*segment, F.lit(None).cast("binary").alias("hits"))
    outcome = C.saved(compared.unionByName(counted).unionByName(often), "outcome")

    # little-endian pairs: from window 0 to window n - 1
    last = F.unhex(F.concat(*(F.lpad(F.hex(F.shiftright(F.col("n") - 1, 8 * k).bitwiseAND(255)), 2, "0") for k in range(4))))
    every = F.concat(F.unhex(F.lit("00000000")), last)
    some = flagged.filter("mixed").join(outcome, segment).select(*name, "start", F.coalesce("hits", every).alias("hits"))
    hits = flagged.filter("NOT mixed").select(*name, "start", every.alias("hits")).unionByName(some)
    found = hits.groupBy(name).agg(F.collect_set(F.struct("start", "hits")).alias("found"))  # rows repeated have the same
    return named.join(found, name, "left").select("doc_id", "text", "found").mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")

"""Near-duplicates by SimHash fingerprints, found through Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21. If two differ in at most 2 bits, then for some
segment they agree, and in the next (round the ring) they differ in one bit at most: by the pigeonhole either one
segment has both errors and the two others none, or the segment before the one without an error has at most one.
Keys are therefore an exact segment with a codeword index near the next segment: one key a segment on one side of
the join, up to six on the other (golay.nearby). Rows that meet under a key are verified by their Hamming distance.
A key under which very many different fingerprints meet is narrowed by bits that it doesn't fix (_spread), so that
its rows are dealt to many tasks.
Under a key only a spanning forest of the links is put out, not all pairs; components of fingerprints are joined
afterwards and named by their smallest document.

Defined results: null text or text without words has fingerprint zero and is linked like any other; rows repeated
share a component; a row with a null doc_id links like any other but never names a component unless all of its rows
are so; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm import common as C
from driftlens.llm.components import components
from driftlens.llm.golay import nearby

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Bits of the fingerprint: (first, width) of each segment.
SEGMENTS = [(0, 22), (22, 21), (43, 21)]
#: Fingerprints that are compared by scanning; more are divided by exact parts first.
SCAN = 512
#: A key is narrowed if it holds more fingerprints than this, however large the table is.
HOT = 4096
CHUNK = 1 << 15
ROWS, KEYED = ["key", "fp", "own", "rest"], "key long, fp long, own boolean, rest long"


def shingle_hashes(text: bytes, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle of a text whose case is already folded, repeats included."""
    words = text.split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, seed)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[: 1 - size].tolist(), ends[size - 1 :].tolist())), dtype=np.uint64, count=len(words) - size + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with C.task_memory():
        for batch in batches:
            found = np.array([fingerprint(shingle_hashes(t.lower())) for t in C.bytes_of(batch)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp, own, rest): own for the side with one key a segment, else for the side with all nearby ones;
    rest has the bits that the key doesn't fix."""
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        part = [(fp >> np.uint64(a) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
        for i in range(3):
            codes = nearby(part[(i + 1) % 3])
            keys = (np.int64(i) << 60 | part[i][:, None] << 12 | codes).astype(np.int64)
            held = codes >= 0
            held[:, 0] = True
            row, column = np.nonzero(held)
            first, width = SEGMENTS[i]
            rest = np.full(len(row), (1 << 64) - 1 ^ ((1 << width) - 1) << first, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys[row, column]), pa.array(fp[row].view(np.int64)), pa.array(column == 0), pa.array(rest)], names=ROWS)


def _narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Three rows for each: of three parts of the rest, two fingerprints within two bits agree in one. Adds part
    and value, which narrow the key, and takes the part's bits from the rest."""
    for batch in batches:
        rest = batch.column("rest").to_numpy(zero_copy_only=False)
        for mask in np.unique(rest):
            rows = batch.filter(pa.array(rest == mask))
            fp = rows.column("fp").to_numpy(zero_copy_only=False)
            bits = [b for b in range(64) if int(mask) >> b & 1]
            for k in range(RADIUS + 1):
                part = np.array(sum(1 << b for b in bits[k :: RADIUS + 1]), dtype=np.uint64).view(np.int64)
                left = np.full(len(fp), mask & ~part)
                yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(left), pa.array(np.full(len(fp), k)), pa.array(fp & part)], names=[*ROWS, "part", "value"])


def _spread(keys: DataFrame) -> DataFrame:
    """Rows (key, fp, own) of the keys, hot ones narrowed until none is left. Ends, as a group whose rest has n bits
    has at most 2^n fingerprints, which is no more than HOT after a few levels. Hot keys are a table: Spark sends it to
    the tasks where its files are small, and shuffles it like any other where they aren't."""
    done = None
    while True:
        hot = C.saved(keys.groupBy("key").count().filter(F.col("count") > HOT).select("key"), "hot")
        none = hot.isEmpty()
        cool = (keys if none else keys.join(hot, "key", "left_anti")).select("key", "fp", "own")
        done = cool if done is None else done.unionByName(cool)
        if none:
            return done
        parts = keys.join(hot, "key", "left_semi").mapInArrow(_narrowed, f"{KEYED}, part long, value long")
        keys = C.saved(parts.withColumn("key", F.xxhash64("key", "part", "value")).drop("part", "value"), "narrowed")


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links (positions in fps, all different) that join whatever is connected within the radius. Many fingerprints
    are divided by the bits in which they differ at all: of three parts of those, two within two bits agree in one."""
    differ = int(np.bitwise_or.reduce(fps ^ fps[0]))
    bits = [b for b in range(64) if differ >> b & 1]
    if len(fps) <= SCAN or len(bits) <= 6:
        return _grow(fps)
    found = []
    for k in range(RADIUS + 1):
        part = fps & np.uint64(sum(1 << b for b in bits[k :: RADIUS + 1]))
        order = np.argsort(part, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            if len(at) > 1:
                found += [(int(at[i]), int(at[j])) for i, j in forest(fps[at])]
    return found


def _grow(fps: np.ndarray) -> list[tuple[int, int]]:
    found, left = [], np.arange(len(fps))
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(fps[left] ^ fps[x]) <= RADIUS
            if near.any():
                reached = left[near].tolist()
                found += [(x, y) for y in reached]
                front += reached
                left = left[~near]
    return found


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among sorted rows; a key's rows may go on from batch to batch."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def found(key, fp, own):
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        # a key matters if a row of the one-key side meets another fingerprint
        differ = (np.maximum.reduceat(fp, start) != np.minimum.reduceat(fp, start)) & np.logical_or.reduceat(own, start)
        ends = np.append(start[1:], len(key))
        pairs: list[tuple[int, int]] = []
        for a, b in zip(start[differ].tolist(), ends[differ].tolist()):
            group = np.unique(fp[a:b])
            pairs += [(int(group[i].view(np.int64)), int(group[j].view(np.int64))) for i, j in forest(group)]
        columns = list(zip(*pairs)) or [(), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in ("key", "fp", "own"))
        held.append((rows[0], rows[1].view(np.uint64), rows[2]))
        if held[0][0][0] != rows[0][-1]:  # a key has ended
            key, fp, own = (np.concatenate(c) for c in zip(*held))
            cut = int(np.searchsorted(key, key[-1]))
            yield found(key[:cut], fp[:cut], own[:cut])
            held = [(key[cut:], fp[cut:], own[cut:])]
    if held:
        yield found(*(np.concatenate(c) for c in zip(*held)))


def near_links(nodes: DataFrame) -> DataFrame:
    """Links a, b that join whatever is connected within the radius. nodes: fp (long), each once."""
    keys = _spread(C.saved(nodes.select("fp").mapInArrow(_keys, KEYED), "keys"))
    return keys.repartition(C.partitions(nodes.sparkSession), "key").sortWithinPartitions("key").mapInArrow(_links, "a long, b long").distinct()


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id
    reachable over links of at most two differing bits)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = C.saved(docs.mapInArrow(_fingerprints, "doc_id long, fp long"), "fingerprints")
    nodes = C.saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    found = components(near_links(nodes))
    members = C.saved(nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("root")), "members")
    names = members.groupBy("root").agg(F.min("first").alias("component_id"))  # the smallest that isn't null
    named = members.join(names, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Benchmark decontamination by SimHash over item-sized windows.

A window of as many words as a benchmark item has is fingerprinted from its five-word shingles (weighted by how
often they occur), for each length that items have, by sums of bits up to each shingle. The items' fingerprints stand
in a multi-index: for each length four blocks of 16 bits, each listed under every value within 4 bits, so that any
fingerprint within 19 bits of an item's is met under some block. What is met within that radius is verified by the
exact weighted Jaccard similarity of the shingles, at least 0.8.

A window can only pass if eight ninths of its shingles are the item's (less where the document is shorter than the
item), so windows are made at all starts where as many shingles of whatever items stand, and at no others, of the
lengths of items with which the text shares as many. The one thing that could be lost is a window that is as similar and
yet over 19 bits away: tests/llm looks for one.

Up to ITEMS items are one index, which is broadcast, and documents are judged where they are. More items are a table: each
is listed under its rarest shingles, so many that a document which is similar enough must hold one. One reading of the
documents, through a filter of fixed size, finds those that may hold a listed shingle; a join on shingles gives the pairs of
document and item, and each document is searched as above for its own items only. Both ways give the same rows.

Defined results: null text, items without words and items with a null item_id match nothing; texts or items of fewer than five words are one
shingle; rows repeated each get their own rows; of equally similar windows the first is named; an empty table on
either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm import common as C

SHINGLE, SIMILAR, RADIUS = 5, 0.8, 19
BLOCKS = 4
#: Items in the broadcast index, some 40 KB each; more are joined.
ITEMS = 1000
#: Bits of the filter of listed shingles: 4 MB, whatever their number.
FILTER = 1 << 25
#: Hashes of words that a task remembers, some 15 MB.
CACHED_WORDS = 100_000
#: Windows fingerprinted at a time.
CHUNK = 4096

FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("n_words", pa.int64()), ("hamming", pa.int64()), ("similarity", pa.float64())])

FOUND_DDL = "doc_id long, item_id long, start long, n_words long, hamming long, similarity double"


class Words(dict):
    """64-bit hashes of words, remembered while a task runs."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_words = Words()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(h: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Mixed hashes of runs of size words; of all words if there are fewer."""
    size = min(size, len(h))
    if not size:
        return h
    s = np.zeros(len(h) - size + 1, dtype=np.uint64)
    for k in range(size):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(s)]
    s ^= s >> np.uint64(31)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    return s ^ s >> np.uint64(29)


def _block(prints: np.ndarray, b: int) -> np.ndarray:
    return (prints >> np.uint64(16 * b) & np.uint64(0xFFFF)).astype(np.int64)


def simhashes(s: np.ndarray, length: int) -> np.ndarray:
    """Fingerprints of all runs of length shingles."""
    bits = np.unpackbits(s.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)))
    return np.packbits((sums[length:] - sums[:-length]) * 2 > length, axis=1, bitorder="little").view("<u8")[:, 0]


def simhash(s: np.ndarray) -> int:
    bits = np.unpackbits(s.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(s), bitorder="little").view("<u8")[0])


def needed(length, n):
    """Shingles that a window of n must share with an item of length to be similar enough."""
    return np.ceil(SIMILAR * (n + length) / (1 + SIMILAR) - 1e-9)


@dataclass
class Index:
    items: list[tuple[int, int, Counter, int]]  # item_id, words, shingles, fingerprint
    slots: np.ndarray  # length's number, block and value of each entry, ascending
    entries: np.ndarray  # their items
    lengths: list[int]  # different lengths of items, in shingles
    anchors: np.ndarray  # shingles of items, ascending
    holders: tuple[np.ndarray, np.ndarray, np.ndarray]  # where each one's items begin; the items, and how often each has it
    gate: np.ndarray  # by the last 20 bits of a shingle: some item has one
    short: dict[int, dict[int, list[int]]]  # items of fewer words than a shingle: by words, by hash

    @classmethod
    def build(cls, rows: list[tuple[int, str | None]]) -> Index:
        items, short, long = [], {}, []
        for item_id, text in sorted(rows, key=lambda r: (r[0], r[1] or "")):
            s = shingles(h := hashes(C.words_of((text or "").encode())))
            if not len(s):
                continue
            if len(h) < SHINGLE:
                short.setdefault(len(h), {}).setdefault(int(s[0]), []).append(len(items))
            else:
                long.append(len(items))
            items.append((item_id, len(h), Counter(s.tolist()), simhash(s)))
        size = np.array([items[i][1] - SHINGLE + 1 for i in long], dtype=np.int64)
        lengths = np.unique(size)
        masks = np.array([sum(1 << b for b in bits) for n in range(RADIUS // BLOCKS + 1) for bits in combinations(range(16), n)], dtype=np.int64)
        prints = np.array([items[i][3] for i in long], dtype=np.uint64)
        base = np.searchsorted(lengths, size) * BLOCKS << 16
        slots = np.concatenate([(base + (b << 16))[:, None] + (_block(prints, b)[:, None] ^ masks) for b in range(BLOCKS)]).reshape(-1)
        entries = np.tile(np.repeat(np.array(long, dtype=np.int32), len(masks)), BLOCKS)
        order = np.argsort(slots, kind="stable")
        held = sorted((x, i, c) for i in long for x, c in items[i][2].items())
        anchor, first = np.unique(np.array([x for x, *_ in held], dtype=np.uint64), return_index=True)
        holders = (np.append(first, len(held)), np.array([i for _, i, _ in held], dtype=np.int64), np.array([c for *_, c in held], dtype=np.int64))
        gate = np.zeros(1 << 20, dtype=bool)
        gate[(anchor & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        return cls(items, slots[order], entries[order], lengths.tolist(), anchor, holders, gate, short)

    def within(self, k: int, prints: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each fingerprint the items of the k-th length within the radius, and their distances."""
        met: list[dict[int, int]] = [{} for _ in prints]
        for b in range(BLOCKS):
            slot = (k * BLOCKS + b << 16) + _block(prints, b)
            low, high = np.searchsorted(self.slots, slot, "left"), np.searchsorted(self.slots, slot, "right")
            for at in np.flatnonzero(high > low).tolist():
                for i in self.entries[low[at] : high[at]].tolist():
                    if i not in met[at] and (d := (self.items[i][3] ^ int(prints[at])).bit_count()) <= RADIUS:
                        met[at][i] = d
        return [sorted(m.items()) for m in met]

    def windows(self, s: np.ndarray, length: int, upto: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold enough shingles of items for an item of length to pass. upto: how many such
        shingles stand before each place."""
        n = min(length, len(s))
        return np.flatnonzero(upto[n:] - upto[:-n] >= needed(length, n))

    def search(self, words: list[bytes]) -> list[tuple[int, int, int, int, float]]:
        """(item_id, start, words, distance, similarity) of the best window for each item that passes."""
        best: dict[int, tuple] = {}
        h = hashes(words)
        s = shingles(h)
        known = self.gate[(s & np.uint64((1 << 20) - 1)).astype(np.int64)] if len(h) >= SHINGLE else np.zeros(0, bool)
        if known.any() and len(self.anchors):
            at = np.flatnonzero(known)
            place = np.minimum(np.searchsorted(self.anchors, s[at]), len(self.anchors) - 1)
            anchor = np.full(len(s), -1)
            anchor[at] = np.where(self.anchors[place] == s[at], place, -1)
            upto = np.concatenate(([0], np.cumsum(anchor >= 0)))
            # no window shares more with an item than the whole text does
            sizes = np.array([size - SHINGLE + 1 for _, size, *_ in self.items])
            likely = set(sizes[self.shared(anchor) >= needed(sizes, np.minimum(sizes, len(s)))].tolist())
            for k, length in enumerate(self.lengths):
                if length in likely:
                    self._compare(k, s, anchor, self.windows(s, length, upto), min(length, len(s)), best)
        for size, own in self.short.items():  # one shingle: the words themselves
            if len(h) >= size:
                one = shingles(h, size)
                for start in np.flatnonzero(np.isin(one, np.array(list(own), dtype=np.uint64))).tolist():
                    for i in own[int(one[start])]:
                        best.setdefault(i, (self.items[i][0], start, size, 0, 1.0))
        return [best[i] for i in sorted(best)]

    def shared(self, anchors: np.ndarray) -> np.ndarray:
        """For each item how many shingles it shares with a window, weighted by how often they occur. anchors: numbers of
        the window's shingles among those of items, -1 for others."""
        mine, times = np.unique(anchors[anchors >= 0], return_counts=True)
        first, items, counts = self.holders
        n = first[mine + 1] - first[mine]
        at = np.arange(n.sum()) + np.repeat(first[mine] - np.cumsum(n) + n, n)
        return np.bincount(items[at], weights=np.minimum(counts[at], np.repeat(times, n)), minlength=len(self.items))

    def _compare(self, k: int, s: np.ndarray, anchor: np.ndarray, starts: np.ndarray, n: int, best: dict[int, tuple]) -> None:
        """Fingerprints of the windows of n shingles at starts, and what the index finds for them, verified."""
        length = self.lengths[k]
        for part in np.split(starts, np.flatnonzero((np.diff(starts) > n) | (np.diff(starts // CHUNK) > 0)) + 1) if len(starts) else ():
            first = int(part[0])
            different, number = np.unique(simhashes(s[first : part[-1] + n], n)[part - first], return_inverse=True)
            found = self.within(k, different)
            for start, m in zip(part.tolist(), number.tolist()):
                if found[m]:
                    shared = self.shared(anchor[start : start + n])
                    for i, d in found[m]:
                        both = float(shared[i])
                        if (j := both / (n + length - both)) >= SIMILAR and j > best.get(i, (0,) * 5)[4]:
                            best[i] = (self.items[i][0], start, n + SHINGLE - 1, d, j)


def _scan(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = sent.value
        with C.task_memory(_words):
            for batch in batches:
                rows = [(doc_id, *hit) for doc_id, text in zip(C.ids_of(batch).tolist(), C.bytes_of(batch)) for hit in index.search(C.words_of(text))]
                columns = list(zip(*rows)) or [()] * len(FOUND)
                yield pa.RecordBatch.from_arrays([C.id_array(columns[0]), *(pa.array(c, f.type) for c, f in zip(columns[1:], list(FOUND)[1:]))], schema=FOUND)

    return run


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id IS NOT NULL").distinct()


def _index(items: DataFrame) -> Broadcast:
    return items.sparkSession.sparkContext.broadcast(Index.build([(r["item_id"], r["text"]) for r in items.collect()]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, items: int = ITEMS) -> DataFrame:
    """One row for each document and benchmark item that it holds: doc_id, item_id, start (word from 0), n_words,
    hamming, similarity, of the most similar window. items: how many at most are broadcast."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = _items(benchmark)
    if known.count() > items:
        return _joined(docs, known).select(FOUND.names)
    return docs.mapInArrow(_scan(_index(known)), FOUND_DDL)


def keep_clean(docs: DataFrame, benchmark: DataFrame, items: int = ITEMS) -> DataFrame:
    """The rows of docs, all columns, that hold no benchmark item. With up to items of them rows are judged where they are,
    without a shuffle; else by id and text."""
    known = _items(benchmark)
    if known.count() > items:
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        leaks = C.saved(_joined(texts, known).select(F.col("doc_id").alias("leak"), "row").distinct(), "leaks")
        own = F.xxhash64(F.col("text").cast("string"))
        return docs.join(leaks, docs["doc_id"].cast("long").eqNullSafe(leaks["leak"]) & (own == leaks["row"]), "left_anti")
    sent = _index(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = sent.value
        with C.task_memory(_words):
            for batch in batches:
                yield batch.filter(pa.array([not index.search(C.words_of(t)) for t in C.bytes_of(batch)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


# ---- more items than are broadcast ---------------------------------------------------------------------------------
def codes(words: list[bytes], sizes: list[int]) -> np.ndarray:
    """What a text can meet items by: its shingles, and for each of sizes (below SHINGLE) its runs of so many words."""
    h = hashes(words)
    found = [shingles(h)] if len(h) >= SHINGLE else []
    found += [shingles(h, n) ^ np.uint64(n) for n in sizes if len(h) >= n]
    return np.concatenate(found).view(np.int64) if found else np.zeros(0, dtype=np.int64)


def _item_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each different code of an item: how often it has it, how many it has in all, and its words below SHINGLE."""
    for batch in batches:
        rows = []
        for item, text in zip(batch.column("item").to_pylist(), C.bytes_of(batch)):
            words = C.words_of(text)
            if words:
                own, times = np.unique(codes(words, [len(words)] if len(words) < SHINGLE else []), return_counts=True)
                rows += [(item, int(c), int(t), int(times.sum()), min(len(words), SHINGLE)) for c, t in zip(own, times)]
        columns = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "code", "times", "total", "size"])


def listed(found: list[tuple[int, int, int]], total: int) -> list[int]:
    """Of an item's codes (how many items have it, code, times), rarest first, so many that a window which lacks them all can't
    be similar enough."""
    missing, out = total - int(np.ceil(SIMILAR * total - 1e-9)), []
    for _, code, times in sorted(found):
        out.append(code)
        missing -= times
        if missing < 0:
            break
    return out


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(item, code) for item, total, found in zip(*(batch.column(k).to_pylist() for k in ("item", "total", "found"))) for code in listed([(f["n"], f["code"], f["times"]) for f in found], total)]
        columns = list(zip(*rows)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "code"])


def _filter_of(index: DataFrame) -> np.ndarray:
    """One bit for each value of a code's last bits, packed; parts of it are merged through a tree."""

    def bits(rows: Iterator) -> Iterator[np.ndarray]:
        held = np.zeros(FILTER, dtype=bool)
        held[np.fromiter((r["code"] & (FILTER - 1) for r in rows), dtype=np.int64)] = True
        yield np.packbits(held)

    def either(a: np.ndarray | None, b: np.ndarray | None) -> np.ndarray | None:
        return b if a is None else a if b is None else a | b

    found = index.select("code").rdd.mapPartitions(bits).treeAggregate(None, either, either)
    return np.zeros(FILTER // 8, dtype=np.uint8) if found is None else found


def _suspects(sent: Broadcast, sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(sent.value).view(bool)
        with C.task_memory(_words):
            for batch in batches:
                found = []
                for text in C.bytes_of(batch):
                    own = codes(C.words_of(text), sizes)
                    found.append(np.unique(own[held[own & (FILTER - 1)]]))
                rows = batch.append_column("codes", pa.array(found, pa.list_(pa.int64())))
                yield rows.filter(pa.array([len(f) > 0 for f in found], pa.bool_()))

    return run


def _search_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document against its own items."""
    with C.task_memory(_words):
        for batch in batches:
            rows = []
            for doc_id, row, text, items in zip(C.ids_of(batch).tolist(), batch.column("row").to_pylist(), C.bytes_of(batch), batch.column("items").to_pylist()):
                index = Index.build([(i["item_id"], i["text"]) for i in items])
                rows += [(doc_id, row, *hit) for hit in index.search(C.words_of(text))]
            columns = list(zip(*rows)) or [()] * (len(FOUND) + 1)
            yield pa.RecordBatch.from_arrays([C.id_array(columns[0]), pa.array(columns[1], pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns[2:], list(FOUND)[1:]))], names=["doc_id", "row", *FOUND.names[1:]])


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """FOUND and row, a hash of the text."""
    items = C.saved(items.select("item_id", "text", F.xxhash64("item_id", "text").alias("item")), "items")
    coded = C.saved(items.select("item", "text").mapInArrow(_item_codes, "item long, code long, times long, total long, size long"), "codes")
    sizes = [r["size"] for r in coded.filter(F.col("size") < SHINGLE).select("size").distinct().collect()]  # four at most
    often = coded.groupBy("code").agg(F.countDistinct("item").alias("n"))
    own = coded.join(often, "code").groupBy("item", "total").agg(F.collect_list(F.struct("n", "code", "times")).alias("found"))  # as long as the item
    index = C.saved(own.mapInArrow(_listed, "item long, code long"), "listed")
    sent = docs.sparkSession.sparkContext.broadcast(_filter_of(index))
    marked = docs.select(F.coalesce("doc_id", F.lit(C.NULL_ID)).alias("id"), F.xxhash64("text").alias("row"), "text")
    suspects = C.saved(marked.mapInArrow(_suspects(sent, sorted(sizes)), "id long, row long, text string, codes array<long>"), "suspects")
    pairs = suspects.select("id", "row", F.explode("codes").alias("code")).join(index, "code").select("id", "row", "item").distinct()
    wanted = C.saved(pairs.join(items, "item").groupBy("id", "row").agg(F.collect_list(F.struct("item_id", "text")).alias("items")), "wanted")
    return suspects.select(F.nullif("id", F.lit(C.NULL_ID)).alias("doc_id"), "id", "row", "text").join(wanted, ["id", "row"]).select("doc_id", "row", "text", "items").mapInArrow(_search_own, f"doc_id long, row long, {FOUND_DDL.partition(', ')[2]}")

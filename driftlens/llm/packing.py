"""Packing by power-of-two decomposition.

A document's ids are cut into pieces of 4096 and then the binary digits of the rest, largest first; each piece is a
sequence of its own, so no sequence crosses documents and none needs padding. Sequences of equal length form a
bucket; a batch is drawn from one bucket. It is one narrow pass: no shuffle, no state.

Defined results: null or empty text is the end id alone; rows repeated each get their own sequences; a null doc_id
stays null; an empty table gives no sequences; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm import common as C
from driftlens.llm.tokens import encoder, portions

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("bucket", pa.int32()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
DDL = "doc_id long, start long, length long, ids binary, doc_tokens long, bucket int, sequence_id long, offset long"


def cuts(n: int, most: int) -> list[int]:
    """Lengths of the pieces of n ids: whole sequences, then the binary digits of what is left."""
    rest = n % most
    return [most] * (n // most) + [1 << k for k in range(most.bit_length() - 1, -1, -1) if rest >> k & 1]


def _pack(path: str, end_id: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = encoder(path), np.array([end_id], dtype="<u4").tobytes()
        used = [0] * most.bit_length()
        base = TaskContext.get().partitionId() << 34
        for batch in batches:
            ids, texts = C.ids_of(batch).tolist(), C.strings_of(batch)
            for a, b in portions(texts):
                rows: list[tuple] = []
                for doc_id, data in zip(ids[a:b], tokenizer.ids(texts[a:b])):
                    data += end
                    n, start = len(data) // 4, 0
                    for length in cuts(n, most):
                        k = length.bit_length() - 1
                        rows.append((doc_id, start, length, data[4 * start : 4 * (start + length)], n, k, (k << 58) + base + used[k], 0))
                        used[k] += 1
                        start += length
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([C.id_array(columns[0]), *(pa.array(c, f.type) for c, f in zip(columns[1:], list(PIECES)[1:]))], schema=PIECES)

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, most: int = 4096) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, bucket (log2 of
    the length), sequence_id (bucket, task and count), offset. most: a power of two."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_pack(tokenizer_path, end_id, most), DDL)

"""Plumbing shared by the operators: shared folders, saved tables and Arrow columns."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Stands for a null doc_id inside Arrow code; it sorts before every real id.
NULL_ID = -(2**63)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local one takes a temporary folder; a
    cluster, whose machines don't share those, must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="driftlens-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ids_of(batch: pa.RecordBatch, name: str = "doc_id") -> np.ndarray:
    """An id column as int64, nulls as NULL_ID."""
    return batch.column(name).cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def id_array(ids) -> pa.Array:
    ids = np.asarray(ids, dtype=np.int64)
    return pa.array(ids, mask=ids == NULL_ID)


def bytes_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A text column as UTF-8 bytes, nulls as empty."""
    return [b if b is not None else b"" for b in batch.column(name).cast(pa.binary()).to_pylist()]


def strings_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return [s if s is not None else "" for s in batch.column(name).to_pylist()]


@contextlib.contextmanager
def task_memory(*held) -> Iterator[None]:
    """Around what a task does: at its end what it has held (anything with clear()) is emptied, and freed memory goes back
    to the system. Python workers live on from stage to stage."""
    try:
        yield
    finally:
        for h in held:
            h.clear()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass


def no_rows(schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([], schema=schema)


#: Makes every ASCII byte that is neither digit nor lower-case letter a space; other bytes belong to words.
SEPARATORS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words: digits, letters and whatever isn't ASCII."""
    return text.lower().translate(SEPARATORS).split()

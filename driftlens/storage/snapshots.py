"""Approved versions as a table that batches are merged into, bucketed by thing.

A batch is one partition of files, dealt to the table's buckets; writing it shuffles that batch and nothing else, and
writing it again replaces it. Readers merge: a scan takes the files of a bucket from all batches together, so the latest
version of a thing and the as-of join find a thing's rows in one task, without shuffling what was stored before.
compact() rewrites the batches of the past as one and drops those; as the merge doesn't mind rows that stand twice, a
crash between the two loses nothing and repeats nothing.

The table lives in the session's catalog at a path of the caller's; a new session opens it by the same name and path.
Rows without a thing or a community are ignored, and one without a time is stored and never holds; of two versions of a thing approved at one time the one of the later batch holds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlens.config import TTL_DAYS
from driftlens.operators import watch
from driftlens.operators.watch import KEY


class SnapshotStore:
    """schema: community_id, thing_id, approved_at and more (the columns of approvals)."""

    def __init__(self, spark: SparkSession, name: str, path: str, schema: T.StructType, buckets: int = 64):
        self.spark, self.name, self.columns, self.buckets = spark, name, schema.names, buckets
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/_schema")  # the folder is there from the start
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}, batch BIGINT) USING parquet PARTITIONED BY (batch) CLUSTERED BY ({', '.join(KEY)}) INTO {buckets} BUCKETS LOCATION '{path}'")
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")

    def upsert(self, approvals: DataFrame, batch: int) -> None:
        """Writes a batch, or writes it again. Batches are numbered from 0 in the order of their coming."""
        if batch < 0:
            raise ValueError("batches are numbered from 0")
        self._write(approvals.filter(F.col("thing_id").isNotNull() & F.col("community_id").isNotNull()).select(self.columns), batch)

    def _write(self, rows: DataFrame, batch: int, how: str = "OVERWRITE TABLE") -> None:
        view = f"batch_{uuid.uuid4().hex}"
        rows.repartition(self.buckets, *KEY).createOrReplaceTempView(view)  # a task holds one bucket, so writes one file
        try:
            self.spark.sql(f"INSERT {how} {self.name} PARTITION (batch = {batch}) SELECT * FROM {view}")
        finally:
            self.spark.catalog.dropTempView(view)

    def rows(self) -> DataFrame:
        """Every stored row with its batch; those of compacted batches have batch -1 or less, and may stand twice."""
        return self.spark.table(self.name)

    def versions(self) -> DataFrame:
        """Each stored version of each thing once. A window within buckets: nothing is shuffled."""
        newest = W.partitionBy(*KEY, "approved_at").orderBy(F.desc("batch"))
        return self.rows().withColumn("_n", F.row_number().over(newest)).filter("_n = 1").select(self.columns)

    def latest(self) -> DataFrame:
        """The version of each thing that was approved last."""
        rest = [c for c in self.columns if c not in KEY]
        found = self.rows().groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.struct("approved_at", "batch")).alias("s"))
        return found.select(*KEY, "s.*")

    def as_of(self, edits: DataFrame, ttl_days: float = TTL_DAYS) -> DataFrame:
        """watch.as_of against the store, as a join with the spans in which versions hold: only the edits are dealt out, to
        the store's buckets."""
        until = F.lead("approved_at").over(W.partitionBy(*KEY).orderBy("approved_at"))
        spans = self.versions().filter(F.col("approved_at").isNotNull()).withColumn("_until", until)
        spans = spans.select(*(F.col(k).alias(f"_{k}") for k in KEY), *(c for c in spans.columns if c not in KEY))
        same = F.lit(True)
        for k in KEY:
            same &= F.col(k) == F.col(f"_{k}")
        holds = (F.col("approved_at") <= F.col("edited_at")) & (F.col("_until").isNull() | (F.col("edited_at") < F.col("_until")))
        found = edits.join(spans, same & holds).filter(watch.live(F.col("approved_at"), F.col("edited_at"), ttl_days))
        return found.drop("_until", *(f"_{k}" for k in KEY)).withColumn("minutes_since_approval", (F.unix_micros("edited_at") - F.unix_micros("approved_at")) / 6e7)

    def batches(self) -> list[int]:
        return sorted(int(r[0].split("=")[1]) for r in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect())

    def compact(self, keep_from: str | None = None) -> None:
        """Merges all batches into one. keep_from: a time; versions that a later one had replaced by then are dropped, so
        edits after it still meet what held."""
        merged = self.batches()
        if not merged:
            return
        kept = self.versions()
        if keep_from is not None:
            later = F.lead("approved_at").over(W.partitionBy(*KEY).orderBy("approved_at"))
            kept = kept.withColumn("_later", later).filter(F.col("_later").isNull() | (F.col("_later") > F.lit(keep_from).cast("timestamp"))).drop("_later")
        self._write(kept, min(merged[0], 0) - 1, "INTO")  # a partition that isn't read
        for batch in merged:
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (batch = {batch}) PURGE")

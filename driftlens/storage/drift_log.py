"""The bounded log as a table that batches are merged into: a batch rewrites only what it touches.

Communities are dealt to buckets. A batch reads the buckets that its communities are in, merges itself into them and
writes them under its own number; a manifest, one small file written last, says for each bucket which batch wrote it.
Other buckets keep their files. A batch that fails has no manifest and isn't seen; one that is run again starts from the
manifest before it, so it gives the same log. The last KEEP manifests and what they name stay, for readers that have begun;
older files are removed.

Null communities are one community. An empty batch changes nothing. A bucket holds at most the limit of each community.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.config import LOG_LIMIT
from driftlens.operators import log

KEEP = 3
MANIFEST = "bucket int, written long, batch long"


class LogTable:
    """Each community's newest events, one for each thing."""

    def __init__(self, spark: SparkSession, path: str, limit: int = LOG_LIMIT, buckets: int = 64, keep: int = KEEP):
        self.spark, self.path, self.limit, self.buckets, self.keep = spark, path, limit, buckets, keep

    def manifests(self) -> dict[int, dict[int, int]]:
        """For each batch that is kept: which batch wrote each bucket."""
        try:
            rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest").collect()  # buckets x keep rows
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        found: dict[int, dict[int, int]] = {}
        for r in rows:
            found.setdefault(r["batch"], {})[r["bucket"]] = r["written"]
        return found

    def _rows(self, buckets: dict[int, int]) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.path}/rows/batch={written}/bucket={bucket}" for bucket, written in sorted(buckets.items())))

    def write(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch. Merges a batch of log rows; numbers grow, the last may come again."""
        dealt = batch.withColumn("bucket", F.pmod(F.hash("community_id"), F.lit(self.buckets)))
        touched = {r["bucket"] for r in dealt.select("bucket").distinct().collect()}
        if not touched:
            return
        kept = self.manifests()
        before = kept[max(k for k in kept if k < number)] if any(k < number for k in kept) else {}
        old = {b: written for b, written in before.items() if b in touched}
        held = batch if not old else self._rows(old).unionByName(batch)
        rows = log.retain(log.latest_per_thing(held), self.limit).select(batch.columns).withColumn("bucket", F.pmod(F.hash("community_id"), F.lit(self.buckets)))
        rows.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/batch={number}")
        now = before | dict.fromkeys(touched, number)
        manifest = self.spark.createDataFrame(sorted(now.items()), "bucket int, written long").coalesce(1)
        manifest.write.mode("overwrite").parquet(f"{self.path}/manifest/batch={number}")
        self._clear({k: v for k, v in kept.items() if k < number} | {number: now})

    def _clear(self, kept: dict[int, dict[int, int]]) -> None:
        """Removes what only manifests before the last few name."""
        stay = sorted(kept)[-self.keep :]
        named = {(written, bucket) for k in stay for bucket, written in kept[k].items()}
        for k in sorted(set(kept) - set(stay)):
            for bucket, written in kept[k].items():
                if (written, bucket) not in named:
                    self._remove(f"{self.path}/rows/batch={written}/bucket={bucket}")
            self._remove(f"{self.path}/manifest/batch={k}")

    def _remove(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def read(self) -> DataFrame | None:
        """The log as the last whole batch left it; None before the first."""
        kept = self.manifests()
        return self._rows(kept[max(kept)]) if kept else None


def log_sink(path: str, limit: int = LOG_LIMIT) -> Callable[[DataFrame, int], None]:
    """LogTable.write at a path, for foreachBatch: the session is the batch's."""
    return lambda batch, number: LogTable(batch.sparkSession, path, limit).write(batch, number)


def read_log(spark: SparkSession, path: str) -> DataFrame | None:
    return LogTable(spark, path).read()

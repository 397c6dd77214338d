"""Jobs that an outside scheduler starts, which do each thing once however often they run or die.

A ledger holds what was done: for each key the row that says so, written in the same step as the row itself. So there is
no moment between a flag and its message: a job that dies before the write has done neither, one that dies after it has
done both, and a batch that comes again replaces its own rows. What goes out of the engine is delivered from the ledger
and marked afterwards; a job that dies between sends again, under the same key, so a receiver can tell.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from driftlens.config import TTL_DAYS
from driftlens.operators.watch import KEY


class Ledger:
    """Rows (schema), at most one for each value of key. Null keys are ignored."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, key: str):
        self.spark, self.path, self.key = spark, path, key
        self.schema = spark.createDataFrame([], schema).schema

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("batch", T.LongType())]))

    def claim(self, rows: DataFrame, number: int, first: str) -> None:
        """Keeps the rows whose key no earlier batch has; of several with one key the one whose column first is least."""
        done = self._read("done", self.schema).filter(F.col("batch") < number).select(self.key)
        fresh = rows.filter(F.col(self.key).isNotNull()).join(done, self.key, "left_anti")
        rest = [c for c in self.schema.names if c != self.key]
        one = fresh.groupBy(self.key).agg(F.min_by(F.struct(*rest), F.struct(first, *rest)).alias("_r")).select(self.key, "_r.*").select(self.schema.names)
        one.write.mode("overwrite").parquet(f"{self.path}/done/batch={number}")

    def rows(self) -> DataFrame:
        return self._read("done", self.schema).select(self.schema.names)

    def pending(self) -> DataFrame:
        """Rows that aren't marked as delivered."""
        sent = self._read("sent", T.StructType([self.schema[self.key]])).select(self.key)
        return self.rows().join(sent, self.key, "left_anti")

    def deliver(self, send: Callable[[DataFrame], None], number: int) -> None:
        """Hands pending rows to send and marks them. Number: grows with each run; a run that died may have it again."""
        held = f"{self.path}/sending/batch={number}"
        self.pending().write.mode("overwrite").parquet(held)
        going = self.spark.read.schema(self.schema).parquet(held)
        send(going)
        going.select(self.key).write.mode("overwrite").parquet(f"{self.path}/sent/batch={number}")


WELCOMES = "community_id string, installed_at timestamp, message string"


def welcome_job(installs: DataFrame, ledger: Ledger, checkpoint: str, name: str) -> StreamingQuery:
    """One run over a stream of installs and upgrades (events.installs): what is new since the last run, then it ends."""

    def write(batch: DataFrame, number: int) -> None:
        message = F.concat(F.lit(f"{name} watches approved content for later edits in "), F.col("community_id"))
        ledger.claim(batch.select("community_id", F.col("at").alias("installed_at"), message.alias("message")), number, "installed_at")

    return installs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def due_after(at: Column, hour: int = 4) -> Column:
    """The first daily run (at that hour, UTC) at or after a time."""
    day, shift = 86400_000_000, hour * 3600_000_000
    return F.timestamp_micros((F.ceil((F.unix_micros(at) - shift) / day) * day + shift).cast("long"))


def prune_runs(approvals: DataFrame, until: dt.datetime, ttl_days: float = TTL_DAYS, hour: int = 4) -> DataFrame:
    """What each daily run up to a time takes off the watch list: community_id, thing_id, approved_at, pruned_at. A thing
    goes with the first run that finds its last approval ttl_days old or older; one that is approved again before that run
    stays. The same rows whether runs happened on time, late or twice."""
    later = F.lead("approved_at").over(W.partitionBy(*KEY).orderBy("approved_at"))
    ends = F.timestamp_micros(F.unix_micros("approved_at") + round(ttl_days * 86400_000_000))
    found = approvals.filter(F.col("approved_at").isNotNull()).select(*KEY, "approved_at", later.alias("_later"), due_after(ends, hour).alias("pruned_at"))
    gone = (F.col("_later").isNull() | (F.col("_later") > F.col("pruned_at"))) & (F.col("pruned_at") <= F.lit(until))
    return found.filter(gone).drop("_later")

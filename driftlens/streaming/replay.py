"""A finished table of events, run through the stream as it might have arrived."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryProgress

from driftlens.streaming.stateful import EVENTS, TICK, carry, shared_dir


def arrivals(events: DataFrame, lateness_hours: float) -> DataFrame:
    """Adds arrived_us: each event arrives up to lateness_hours after its time, by a hash of it."""
    late = F.pmod(F.xxhash64("community_id", "thing_id", "kind", "at", "payload"), F.lit(round(lateness_hours * 3600_000_000)))
    return events.withColumn("arrived_us", F.unix_micros("at") + late)


def replay(events: DataFrame, ttl_days: float, until: dt.datetime, slices: int = 4, lateness_hours: float = 24.0, start: Callable[[DataFrame, str], StreamingQuery] | None = None) -> tuple[DataFrame | None, list[StreamingQueryProgress]]:
    """Deals the events into slices by when they arrived and runs the stream once for each, on the checkpoint that the run
    before left, then once more on a tick that moves the watermark to until. Returns what came out (stateful.carry) and the
    progress of every micro-batch. start: starts the query on a stream of results, given the folder for its checkpoint and output."""
    spark = events.sparkSession
    path = f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}"
    table = f"{path}/arrived"
    arrivals(events, lateness_hours).write.parquet(table)
    arrived = spark.read.parquet(table)
    first, last = arrived.agg(F.min("arrived_us"), F.max("arrived_us")).first()
    first, last = first or 0, last or 0
    spark.createDataFrame([], EVENTS).write.parquet(f"{path}/in")
    stream = carry(spark.readStream.schema(EVENTS).parquet(f"{path}/in"), ttl_days, f"{round(lateness_hours * 3600)} seconds")
    tick = until + dt.timedelta(hours=lateness_hours)
    progress = []
    for k in range(slices + 1):
        if k < slices:
            low, high = (first + (last + 1 - first) * i // slices for i in (k, k + 1))
            part = arrived.filter((F.col("arrived_us") >= low) & (F.col("arrived_us") < high)).drop("arrived_us")
        else:
            part = spark.sql(f"SELECT '' AS community_id, '' AS thing_id, '{TICK}' AS kind, TIMESTAMP '{tick:%Y-%m-%d %H:%M:%S.%f}' AS at, CAST(NULL AS STRING) AS payload")
        part.write.mode("append").parquet(f"{path}/in")
        query = start(stream, path) if start else stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        progress += query.recentProgress
    return (None if start else spark.read.schema(stream.schema).parquet(f"{path}/out")), progress

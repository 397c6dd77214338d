"""The same as-of join over a stream, with expiry.

State is, for each thing, the approvals that an edit may still meet and the edits that wait; things are dealt to buckets,
by a hash, which are what Spark groups by (a bucket's state is read and written whole, so take more where more than some 10,000,000 events are held at once). An edit is joined once the
watermark has passed it, when no earlier approval can still arrive: events may come in any order within the lateness, and
what comes out is what the batch join gives. Event-time timers wake a bucket for its next edit or its next expiry; an
approval goes when a later one holds for all edits to come or when its time is over, and an approval that ran out without
a later one gives an expiry row. State of a thing is bounded by what arrives for it within the lateness.

The last edits of a stream wait until the watermark passes them, so a source that may fall silent should send ticks: events of
kind TICK under a key of their own. Events later than the lateness are dropped by Spark. Rows without a time are ignored;
of two approvals of a thing at one time the one read last counts.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from driftlens.config import TTL_DAYS
from driftlens.operators.watch import KEY
from driftlens.storage.drift_log import log_sink, read_log  # noqa: F401

EVENTS = "community_id string, thing_id string, kind string, at timestamp, payload string"
APPROVAL, EDIT, TICK = "approval", "edit", "tick"
_OUT = "community_id string, thing_id string, kind string, at_us long, approved_us long, edit string, approval string"
BUCKETS = 512
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class AsOf(StatefulProcessor):
    """Approvals and edits of the things of one bucket, in event time. Times are microseconds. A call of Python and a round
    trip to the state cost far more than a row, so things share them: a bucket's rows come and go together."""

    def __init__(self, ttl_us: int):
        self.ttl = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "community_id string, thing_id string, approval boolean, at long, payload string")
        self.wake = handle.getValueState("wake", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        due = []
        for part in rows:
            part = part[part["at_us"].notna() & part["kind"].isin((APPROVAL, EDIT))]
            if len(part):
                part = part.assign(approval=part["kind"] == APPROVAL).astype({"at_us": "int64"})
                self.held.appendList(list(part[[*KEY, "approval", "at_us", "payload"]].itertuples(index=False, name=None)))
                due.append(int((part["at_us"] + self.ttl * part["approval"]).min()))
        self._wake_at(min(due, default=None))
        return iter(())

    def _wake_at(self, at: int | None) -> None:
        """One timer a bucket, for the earliest time that one of its things waits for."""
        now = self.wake.get() if self.wake.exists() else None
        if at is not None and (now is None or at < now[0]):
            if now is not None:
                self.handle.deleteTimer(_timer(now[0]))
            self.handle.registerTimer(_timer(at))
            self.wake.update((at,))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.wake.clear()
        approvals: dict[tuple, dict[int, str]] = defaultdict(dict)
        edits: dict[tuple, list[tuple]] = defaultdict(list)
        stay, due, out, n = [], [], [], 0
        for *thing, approval, at, payload in self.held.get():
            n += 1
            if approval:
                approvals[tuple(thing)][at] = payload
            elif at > passed:
                stay.append((*thing, False, at, payload))
                due.append(at)
            else:
                edits[tuple(thing)].append((at, payload))
        for thing, known in approvals.items():
            known = sorted(known.items())
            k = -1
            for at, edit in sorted(edits[thing], key=lambda e: e[0]):
                while k + 1 < len(known) and known[k + 1][0] <= at:
                    k += 1
                if k >= 0 and at < known[k][0] + self.ttl:
                    out.append((*thing, EDIT, at, known[k][0], edit, known[k][1]))
            for (at, approval), later in zip(known, [a[0] for a in known[1:]] + [None]):
                end = at + self.ttl
                if end <= passed and (later is None or later >= end):
                    out.append((*thing, "expiry", end, at, None, approval))
                if end > passed and (later is None or later > passed):
                    stay.append((*thing, True, at, approval))
                    due.append(end)
        if not stay:
            self.held.clear()
        elif len(stay) < n:
            self.held.put(stay)
        self._wake_at(min(due, default=None))
        if out:
            yield pd.DataFrame(out, columns=[*KEY, "kind", "at_us", "approved_us", "edit", "approval"])

    def close(self) -> None:
        pass


def _timer(at_us: int) -> int:
    """Milliseconds, rounded up: when a watermark of so much has passed, no event at at_us or before can come."""
    return -(-at_us // 1000)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Without one a local session takes a temporary folder; a cluster,
    whose machines don't share those, must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or "file://" + tempfile.mkdtemp(prefix="driftlens-")


def carry(events: DataFrame, ttl_days: float = TTL_DAYS, lateness: str = "1 day", buckets: int = BUCKETS) -> DataFrame:
    """Both kinds of result of a stream of events (EVENTS): edits with the approval that held, and expiries. State is kept in
    RocksDB, which timers need; a session with another provider is set to it."""
    if events.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "") != _ROCKSDB:
        events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    timed = events.withWatermark("at", lateness).withColumns({"at_us": F.unix_micros("at"), "bucket": F.pmod(F.xxhash64(*KEY), F.lit(buckets))})
    return timed.groupBy("bucket").transformWithStateInPandas(AsOf(round(ttl_days * 86400_000_000)), _OUT, "Append", "EventTime")


def joined(carried: DataFrame) -> DataFrame:
    """Edits with the approval that held."""
    return carried.filter(F.col("kind") == EDIT).select(*KEY, F.timestamp_micros("at_us").alias("edited_at"), F.timestamp_micros("approved_us").alias("approved_at"), "edit", "approval")


def expired(carried: DataFrame) -> DataFrame:
    """Approvals that ran out before a later one came."""
    return carried.filter(F.col("kind") == "expiry").select(*KEY, F.timestamp_micros("approved_us").alias("approved_at"), F.timestamp_micros("at_us").alias("expired_at"), "approval")


def as_of_stream(events: DataFrame, ttl_days: float = TTL_DAYS, lateness: str = "1 day") -> DataFrame:
    """Edits of a stream of events (EVENTS; kind: approval, edit or tick) with the approval that holds."""
    return joined(carry(events, ttl_days, lateness))


def encode(df: DataFrame, kind: str, at: str) -> DataFrame:
    """Approvals or edits as events: what isn't a key goes along as JSON."""
    return df.select(*KEY, F.lit(kind).alias("kind"), F.col(at).alias("at"), F.to_json(F.struct(*(c for c in df.columns if c not in KEY))).alias("payload"))

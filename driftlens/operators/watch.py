"""Approvals and edits: the as-of join with expiry, and the watch list.

Keys are (community_id, thing_id). Where an approval and an edit have the same time, the approval comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftlens.config import TTL_DAYS

KEY = ["community_id", "thing_id"]


def seconds(c: Column | str) -> Column:
    return F.unix_micros(c) / 1e6


def live(approved_at: Column, now: Column, ttl_days: float) -> Column:
    return (approved_at <= now) & (seconds(now) < seconds(approved_at) + ttl_days * 86400)


def as_of(edits: DataFrame, approvals: DataFrame, ttl_days: float = TTL_DAYS) -> DataFrame:
    """Every edit whose thing has an approval still live at edited_at, with the latest one's columns.

    edits: community_id, thing_id, edited_at and more; approvals: community_id, thing_id, approved_at and more (of
    other names). Both sides are dealt by key once; no join is needed, a window carries the last approval along.
    """
    extra, own = [c for c in approvals.columns if c not in KEY], [c for c in edits.columns if c not in KEY]
    a = approvals.select(*KEY, F.col("approved_at").alias("_at"), F.lit(0).alias("_kind"), F.struct(*extra).alias("_approval"), F.lit(None).alias("_edit"))
    b = edits.select(*KEY, F.col("edited_at").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).alias("_approval"), F.struct(*own).alias("_edit"))
    events = a.unionByName(b.withColumn("_approval", F.lit(None).cast(a.schema["_approval"].dataType))) if own else a
    order = W.partitionBy(*KEY).orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = events.withColumn("_approval", F.last("_approval", ignorenulls=True).over(order)).filter("_kind = 1 AND _approval IS NOT NULL")
    found = seen.select(*KEY, *(F.col(f"_edit.{c}").alias(c) for c in own), *(F.col(f"_approval.{c}").alias(c) for c in extra))
    return found.filter(live(F.col("approved_at"), F.col("edited_at"), ttl_days)).withColumn("minutes_since_approval", (F.unix_micros("edited_at") - F.unix_micros("approved_at")) / 6e7)


def as_answered(edits: DataFrame, approvals: DataFrame, answers: DataFrame, version: str, ttl_days: float = TTL_DAYS) -> DataFrame:
    """as_of where moderators also answer what was flagged. answers: community_id, thing_id, answered_at, answer. restore
    approves the thing as it then stands: the last edit's version becomes the approved one (its column version; without an
    edit since, the approved version is approved anew), approved at that time by the answer. remove ends the watch until the
    thing is approved or restored again. Other answers change nothing. Adds baseline: what the edit is compared with
    (approval, restore). A null version doesn't change what a thing holds.

    approvals and edits both hold version, the content's column. All events of a thing pass in the order of their times, at one
    time approvals first, then answers, then edits: two windows over one order, so one shuffle and one sort."""
    at = ["approved_at", "answered_at", "edited_at"]
    own = [c for c in edits.columns if c not in (*KEY, version)]
    extra = [c for c in approvals.columns if c not in (*KEY, version)]
    none = lambda df, names: F.lit(None).cast(df.select(F.struct(*names)).schema[0].dataType)
    events = [
        df.select(*KEY, F.col(time).alias("_at"), F.lit(kind).alias("_kind"), *columns)
        for kind, (df, time, columns) in enumerate(zip((approvals, answers.filter(F.col("answer").isin("restore", "remove")), edits), at, (
            (F.lit("approval").alias("_what"), F.struct(*extra).alias("_approval"), none(edits, own).alias("_edit"), F.col(version).alias("_version")),
            (F.col("answer").alias("_what"), none(approvals, extra).alias("_approval"), none(edits, own).alias("_edit"), F.lit(None).cast(edits.schema[version].dataType).alias("_version")),
            (F.lit("edit").alias("_what"), none(approvals, extra).alias("_approval"), F.struct(*own).alias("_edit"), F.col(version).alias("_version")),
        )))
    ]
    every = events[0].unionByName(events[1]).unionByName(events[2])
    order = W.partitionBy(*KEY).orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    # what the thing holds, and by whose approval, at each event
    held = every.withColumns({"_holds": F.last("_version", ignorenulls=True).over(order), "_by": F.last("_approval", ignorenulls=True).over(order)})
    base = lambda *c: F.struct(*(F.col(x).alias(name) for x, name in zip(("_at", "_what", *c), ("at", "baseline", "holds", "by"))))
    based = F.when(F.col("_what") == "approval", base("_version", "_approval")).when(F.col("_what").isin("restore", "remove"), base("_holds", "_by"))
    seen = held.withColumn("_base", F.last(based, ignorenulls=True).over(order)).filter("_what = 'edit' AND _base.baseline IN ('approval', 'restore') AND _base.by IS NOT NULL")
    found = seen.select(
        *KEY, *(F.col(f"_edit.{c}").alias(c) for c in own), F.col("_version").alias(version), *(F.col(f"_base.by.{c}").alias(c) for c in extra if c != "approved_at"),
        F.col("_base.at").alias("approved_at"), F.col("_base.holds").alias(f"approved_{version}"), F.col("_base.baseline").alias("baseline"),
    )
    return found.filter(live(F.col("approved_at"), F.col("edited_at"), ttl_days))


def watch_list(approvals: DataFrame) -> DataFrame:
    """The latest approval of each thing."""
    return approvals.groupBy(*KEY).agg(F.max("approved_at").alias("approved_at"))


def prune(watched: DataFrame, now: Column, ttl_days: float = TTL_DAYS) -> DataFrame:
    """What is left after entries of ttl_days or older are removed."""
    return watched.filter(seconds("approved_at") > seconds(now) - ttl_days * 86400)


def snapshots(approvals: DataFrame) -> DataFrame:
    """The last approved version of each thing, whole: the later one wins."""
    rest = [c for c in approvals.columns if c not in KEY]
    latest = approvals.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "approved_at").alias("s"))
    return latest.select(*KEY, "s.*")


def welcome(installs: DataFrame, onboarded: DataFrame, name: str) -> DataFrame:
    """One message for each community that hasn't had one."""
    fresh = installs.select("community_id").distinct().join(onboarded.select("community_id"), "community_id", "left_anti")
    return fresh.select("community_id", F.concat(F.lit(f"{name} watches approved content for later edits in "), F.col("community_id").cast("string")).alias("message"))

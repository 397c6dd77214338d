"""Settings of a community."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """action: requeue, notify or log; threshold: the least score that counts; late_edit_hours: 0 for never; watch_comments."""

    action: str = "requeue"
    threshold: float = 0.55
    late_edit_hours: float = 0.0
    watch_comments: bool = False

    def __post_init__(self):
        if self.action not in ("requeue", "notify", "log"):
            raise ValueError(f"unknown action {self.action!r}")
        if not 0 <= self.threshold <= 1:
            raise ValueError("the threshold lies between 0 and 1")


def with_defaults(settings: DataFrame, *also: str) -> DataFrame:
    """Settings of communities as a table (community_id, columns named in also, and whichever of the fields of Settings it
    has): what is null, or an action that isn't known, takes its default."""
    have, out = set(settings.columns), [F.col("community_id"), *(F.col(c) for c in also)]
    for f in fields(Settings):
        given = F.col(f.name) if f.name in have else F.lit(None)
        if f.name == "action":
            given = F.when(given.isin("requeue", "notify", "log"), given)
        out.append(F.coalesce(given, F.lit(f.default)).alias(f.name))
    return settings.select(*out)


#: Rows of one community are dealt to so many groups when they meet its settings: it may hold any share of all rows.
SALT = 32


def in_force(rows: DataFrame, settings: DataFrame, at: Column | str) -> DataFrame:
    """rows (with community_id) and the settings that held for their community at a time, as columns of the names of
    Settings' fields. settings: community_id, valid_from and whichever fields there are; what is null in the version that
    holds takes its default, and so does all before a community's first version or where it has none. Of versions of one
    time the one whose values sort last holds; a null valid_from holds from the start; a null time takes the defaults."""
    names = [f.name for f in fields(Settings)]
    taken = [c for c in rows.columns if c in names]
    if taken:
        raise ValueError(f"rows have columns named like settings: {taken}")
    order = W.partitionBy("community_id").orderBy(F.asc_nulls_first("valid_from"))
    versions = with_defaults(settings, "valid_from")
    one = versions.groupBy("community_id", "valid_from").agg(F.max(F.struct(*names)).alias("_s"))
    spans = one.select(F.col("community_id").alias("_community"), "valid_from", F.lead("valid_from").over(order).alias("_until"), "_s")
    spans = spans.withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    at = F.col(at) if isinstance(at, str) else at
    spread = F.xxhash64(at, *(c for c in rows.columns if c == "thing_id"))
    dealt = rows.withColumns({"_time": at, "_at": F.pmod(spread, F.lit(SALT)).cast("int")})
    holds = (F.col("valid_from").isNull() | (F.col("valid_from") <= F.col("_time"))) & (F.col("_until").isNull() | (F.col("_time") < F.col("_until")))
    found = dealt.join(spans, (F.col("community_id") == F.col("_community")) & (F.col("_at") == F.col("_to")) & holds, "left")
    return found.select(*rows.columns, *(F.coalesce(f"_s.{f.name}", F.lit(f.default)).alias(f.name) for f in fields(Settings)))


TTL_DAYS, LOG_LIMIT, READ_LIMIT, DASHBOARD_LIMIT, PAGE = 30, 200, 25, 60, 3

"""Events of the host as approvals and edits; batch and streaming DataFrames alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.config import Settings, in_force
from driftlens.functions.links import REFS, extract_link_refs
from driftlens.functions.urls import parse_urls
from driftlens.functions import links

#: Columns of the raw tables, all optional but the ids, kinds and times.
MOD_ACTIONS = "community_id string, thing_id string, action string, type string, title string, body string, url string, is_self boolean, moderator string, at timestamp"
EDITS = "community_id string, thing_id string, type string, body string, url string, is_self boolean, author string, event_author string, permalink string, at timestamp"

INSTALLS = "community_id string, kind string, at timestamp"

# Events by which a community comes to have the engine, or a new version of it.
INSTALL_KINDS = ["install", "upgrade"]

# Moderator actions that approve.
APPROVALS = ["approvelink", "approvecomment"]


def _own_url() -> Column:
    """A link post's own address counts as a link, whatever its text holds."""
    own = (F.col("type") == "post") & ~F.coalesce("is_self", F.lit(True)) & (F.coalesce("url", F.lit("")) != "")
    return F.when(own, F.array(F.struct(F.col("url").alias("href"), F.lit("").alias("text")))).otherwise(F.array()).cast(REFS)


def approvals(actions: DataFrame) -> DataFrame:
    """Snapshots of what was approved."""
    found = actions.filter(F.col("action").isin(APPROVALS) & F.col("thing_id").isNotNull())
    refs = F.concat(extract_link_refs(F.coalesce("body", F.lit(""))), _own_url())
    found = found.withColumn("_links", F.transform(refs, lambda r: r["href"]))
    return found.select(
        "community_id", "thing_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("body", F.lit("")).alias("approved_body"), F.col("_links").alias("approved_links"),
        links.domains_of(parse_urls("_links")).alias("approved_domains"), F.coalesce("moderator", F.lit("unknown")).alias("approved_by"), F.col("at").alias("approved_at"),
    )


def edits(updates: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Edited versions; comments only if they are watched."""
    found = updates.filter(F.col("thing_id").isNotNull() & ((F.col("type") == "post") | F.lit(settings.watch_comments)))
    return _edited(found, F.lit(float(settings.late_edit_hours)))


def _edited(found: DataFrame, late_edit_hours: Column, *also: str) -> DataFrame:
    return found.select(
        "community_id", "thing_id", "type", F.coalesce("body", F.lit("")).alias("current_body"), F.concat(extract_link_refs(F.coalesce("body", F.lit(""))), _own_url()).alias("current_refs"),
        F.coalesce("author", "event_author", F.lit("unknown")).alias("author"), F.coalesce("permalink", F.lit("")).alias("permalink"), F.col("at").alias("edited_at"), late_edit_hours.alias("late_edit_hours"), *also,
    )


def edits_in_force(updates: DataFrame, settings: DataFrame) -> DataFrame:
    """edits() where each community has settings of its own that change in time (config.in_force): comments count where they
    are watched at the time of the edit, and late_edit_hours, threshold and action of that time go along."""
    found = in_force(updates.filter(F.col("thing_id").isNotNull()), settings, "at").filter((F.col("type") == "post") | F.col("watch_comments"))
    return _edited(found, F.col("late_edit_hours"), "threshold", "action")


def installs(events: DataFrame) -> DataFrame:
    """Communities that installed or upgraded, each event a row."""
    return events.filter(F.col("kind").isin(INSTALL_KINDS) & F.col("community_id").isNotNull())


def json_array(column: Column) -> Column:
    """An array kept as JSON text; what can't be read is empty."""
    return F.coalesce(F.from_json(column, "array<string>"), F.array().cast("array<string>"))

"""The drift log: one event for each thing, the newest of a community, its pages and how they are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftlens.config import DASHBOARD_LIMIT, LOG_LIMIT, PAGE, READ_LIMIT, Settings
from driftlens.operators.watch import KEY

EXCERPT = 300


def two_places(score: Column) -> Column:
    return F.floor(score * 100 + 0.5) / 100


def events(scored: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Log rows of scored edits that reach the threshold."""
    return _rows(scored.filter(F.col("score") >= settings.threshold), F.lit(settings.action))


def events_in_force(scored: DataFrame) -> DataFrame:
    """Log rows of scored edits that reach the threshold that goes along with them, with their action."""
    return _rows(scored.filter(F.col("score") >= F.col("threshold")), F.col("action"))


def _rows(scored: DataFrame, action: Column) -> DataFrame:
    cut = lambda c: F.substring(F.coalesce(c, F.lit("")), 1, EXCERPT)
    return scored.select(
        *KEY, "type", two_places(F.col("score")).alias("score"), "band", "signals", F.coalesce("approved_by", F.lit("unknown")).alias("approved_by"), F.coalesce("author", F.lit("unknown")).alias("author"),
        F.coalesce("permalink", F.lit("")).alias("permalink"), cut("approved_body").alias("before_excerpt"), cut("current_body").alias("after_excerpt"), action.alias("action"), F.col("edited_at").alias("detected_at"),
    )


def by_settings(scored: DataFrame, settings: DataFrame) -> DataFrame:
    """Scored edits that reach their own community's threshold, with its action. settings: config.with_defaults; a
    community that isn't listed takes the defaults."""
    own = settings.select("community_id", F.col("threshold").alias("_threshold"), F.col("action").alias("_action"))
    found = scored.join(own, "community_id", "left").filter(F.col("score") >= F.coalesce("_threshold", F.lit(Settings().threshold)))
    return found.withColumn("action", F.coalesce("_action", F.lit(Settings().action))).drop("_threshold", "_action")


def latest_per_thing(log: DataFrame) -> DataFrame:
    rest = [c for c in log.columns if c not in KEY]
    return log.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "detected_at").alias("e")).select(*KEY, "e.*")


def retain(log: DataFrame, limit: int = LOG_LIMIT) -> DataFrame:
    """The newest events of each community. A rank filter that Spark turns into a limit within each partial group."""
    order = W.partitionBy("community_id").orderBy(F.desc("detected_at"), "thing_id")
    return log.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def recent(log: DataFrame, limit: int = READ_LIMIT) -> DataFrame:
    """Newest first, of one community."""
    return log.orderBy(F.desc("detected_at"), "thing_id").limit(limit)


def page(log: DataFrame, number: int, size: int = PAGE, limit: int = DASHBOARD_LIMIT) -> DataFrame:
    """Rows of a page of the dashboard (from 0), with has_prev, has_next and the number of pages."""
    ranked = recent(log, limit).withColumn("rank", F.row_number().over(W.orderBy(F.desc("detected_at"), "thing_id"))).withColumn("n", F.count("*").over(W.partitionBy(F.lit(1))))
    first = number * size
    shown = ranked.filter((F.col("rank") > first) & (F.col("rank") <= first + size))
    return shown.withColumns({"has_prev": F.lit(number > 0), "has_next": F.col("n") > first + size, "pages": F.greatest(F.lit(1), F.ceil(F.col("n") / size)).cast("int")}).drop("n")


# What the dashboard says.
def action_label(action: Column) -> Column:
    return F.when(action == "requeue", "removed & re-queued").when(action == "notify", "left up, flagged").otherwise("logged")


def age(at: Column, now: Column) -> Column:
    s = F.greatest(F.lit(0), F.floor((F.unix_micros(now) - F.unix_micros(at)) / 1e6)).cast("long")
    show = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(f"{unit} ago"))
    return F.when(s < 60, show(s, "s")).when(s < 3600, show(s / 60, "m")).when(s < 86400, show(s / 3600, "h")).otherwise(show(s / 86400, "d"))


def colour(score: Column) -> Column:
    return F.when(score >= 0.8, "#ff5c5c").when(score >= 0.5, "#ffae42").otherwise("#9aa6ab")


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def render(log: DataFrame, now: Column) -> DataFrame:
    """Cards: badge, score text, colour, age, label of the action and the first three signals."""
    return log.withColumns({
        "badge": F.when(F.col("type") == "post", "POST").otherwise("COMMENT"), "score_text": F.concat(F.lit("drift "), F.format_string("%.2f", "score")), "colour": colour(F.col("score")),
        "age": age(F.col("detected_at"), now), "action_label": action_label(F.col("action")), "shown_signals": F.slice("signals", 1, 3),
    })


def notice(log: DataFrame) -> DataFrame:
    """Message for moderators of events whose action isn't log and whose community is known."""
    done = F.when(F.col("action") == "requeue", "has been removed and re-queued for review").otherwise("is still live and flagged for review")
    head = F.format_string("**Approved content drifted (score %.2f, severity %s)**", F.col("score"), F.upper("band"))
    said = F.concat(F.lit("A "), F.col("type"), F.lit(" by u/"), F.col("author"), F.lit(", approved by u/"), F.col("approved_by"), F.lit(", changed after approval and "), done, F.lit("."))
    bullets = F.array_join(F.transform("signals", lambda s: F.concat(F.lit("- "), s)), "\n")
    body = F.concat_ws("\n", head, F.lit(""), said, F.lit(""), F.lit("**What changed:**"), bullets, F.lit(""), F.concat(F.lit("[View the "), F.col("type"), F.lit("]("), F.col("permalink"), F.lit(")")))
    return log.filter(F.col("action").isin("requeue", "notify") & F.col("community_id").isNotNull()).withColumn("message", body)


def requeued(log: DataFrame) -> DataFrame:
    """Things to take down."""
    return log.filter(F.col("action") == "requeue").select(*KEY, "detected_at")

"""Queries of what is kept and changes in time: stored snapshots, settings by time, answers of moderators, the log that a
stream feeds; and of brands as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens import config
from driftlens.functions import dims, links
from driftlens.operators import brands, log, watch
from driftlens.plans import catalogue as K
from driftlens.plans.registry import registry
from driftlens.storage.snapshots import SnapshotStore
from driftlens.sources import events
from driftlens.storage.drift_log import LogTable
from driftlens.streaming import jobs, stateful
from driftlens.streaming.replay import replay
from driftlens.streaming.stateful import shared_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = registry(QUERIES, ORACLES)

# ---- the snapshot store ------------------------------------------------------------------------------------------------
_COMMUNITY = "'c' || user_id % 25"


def _by_community(df: DataFrame) -> DataFrame:
    return df.withColumn("community_id", F.concat(F.lit("c"), F.col("thing_id").cast("long") % 25))


def _stored(spark: SparkSession, sf_dir: str) -> SnapshotStore:
    """Approvals in three batches, the second of them twice, merged in between."""
    rows = _by_community(K.approvals(spark, sf_dir)).select("community_id", "thing_id", "approved_at", "approval_id")
    name = f"snapshots_{uuid.uuid4().hex}"
    store = SnapshotStore(spark, name, f"{shared_dir(spark)}/{name}", rows.schema, buckets=16)
    bounds = ["2024-01-01", "2024-01-11", "2024-01-21", "2024-03-01"]
    for k, (low, high) in enumerate(zip(bounds, bounds[1:])):
        part = rows.filter((F.col("approved_at") >= low) & (F.col("approved_at") < high))
        for _ in range(2 if k == 1 else 1):
            store.upsert(part, k)
        if k == 1:
            store.compact()
    return store


@query("SELECT user_id::VARCHAR AS thing_id, arg_max(event_id, ts) AS approval_id FROM events WHERE event_type = 'signup' GROUP BY user_id")
def snapshot_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest version of each thing in the store."""
    return _stored(spark, sf_dir).latest().select("thing_id", "approval_id")


@query(f"WITH {K.ASOF_SQL} SELECT event_id, {_COMMUNITY} AS community_id, approval_id FROM j WHERE {K._LIVE}")
def snapshot_store_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits against the store: stored versions stay where they are."""
    return _stored(spark, sf_dir).as_of(_by_community(K.clicks(spark, sf_dir)), K.TTL).select("event_id", "community_id", "approval_id")


# ---- settings that hold from a time on --------------------------------------------------------------------------------
#: Versions of the settings of nations: by the nation's key and k, the number of the version.
_VALID = "CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN TIMESTAMP '2024-01-08 00:00:00' ELSE TIMESTAMP '2024-01-19 12:00:00' END"
_SETTINGS = {
    "action": "CASE (n_nationkey + k) % 4 WHEN 0 THEN 'notify' WHEN 1 THEN 'log' WHEN 2 THEN 'shout' END",
    "threshold": "CASE WHEN (n_nationkey + k) % 3 > 0 THEN CAST((n_nationkey + k) % 3 AS DOUBLE) * CAST(0.35 AS DOUBLE) END",
    "late_edit_hours": "CASE WHEN (n_nationkey + 2 * k) % 5 > 0 THEN CAST((n_nationkey + 2 * k) % 5 * 12 AS DOUBLE) END",
    "watch_comments": "CASE WHEN (n_nationkey + k) % 7 > 1 THEN (n_nationkey + k) % 2 = 0 END",
}
_GIVEN = [f"{v} AS {k}" for k, v in _SETTINGS.items()]


@query(f"""WITH {K.ASOF_SQL}, v AS (SELECT 'c' || n_nationkey AS community_id, coalesce({_VALID}, TIMESTAMP '1900-01-01') AS valid_from, {', '.join(_GIVEN)} FROM nation, range(3) AS r(k) WHERE n_nationkey <> 24),
    s AS (SELECT event_id, {_COMMUNITY} AS community_id, edited_at, (epoch_us(edited_at) - epoch_us(approved_at)) / 6e7 AS minutes, {K._SCORE} AS score, event_id % 3 = 0 AS comment FROM j WHERE {K._LIVE}),
    f AS (SELECT s.*, CASE WHEN action IN ('notify', 'log') THEN action ELSE 'requeue' END AS action, coalesce(threshold, 0.55) AS threshold, coalesce(late_edit_hours, 0.0) AS hours, coalesce(watch_comments, false) AS watched
        FROM s ASOF LEFT JOIN v ON s.community_id = v.community_id AND s.edited_at >= v.valid_from)
    SELECT event_id, action, threshold, hours > 0 AND minutes > hours * 60 AS late FROM f WHERE (NOT comment OR watched) AND score >= threshold""")
def settings_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each edit by the settings that its community had at that time: gaps, an action that isn't known, a community that has none."""
    nations = K.table(spark, sf_dir, "nation").filter("n_nationkey <> 24").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    settings = nations.selectExpr("'c' || n_nationkey AS community_id", f"{_VALID} AS valid_from", *_GIVEN)
    rows = _by_community(K.joined(spark, sf_dir)).withColumns({"score": F.expr(K._SCORE.replace("1.0", "1.0D").replace("20.0", "20.0D")), "comment": F.col("event_id") % 3 == 0})
    found = config.in_force(rows, settings, "edited_at").filter((~F.col("comment") | F.col("watch_comments")) & (F.col("score") >= F.col("threshold")))
    late = (F.col("late_edit_hours") > 0) & (F.col("minutes_since_approval") > F.col("late_edit_hours") * 60)
    return found.select("event_id", "action", "threshold", late.alias("late"))


# ---- answers of moderators ------------------------------------------------------------------------------------------------
@query(f"""WITH e AS (SELECT user_id, ts, event_id, event_type, CASE event_type WHEN 'signup' THEN 0 WHEN 'click' THEN 2 ELSE 1 END AS kind FROM events WHERE event_type <> 'view'),
    h AS (SELECT *, last_value(CASE WHEN kind <> 1 THEN 'v' || event_id END IGNORE NULLS) OVER w AS holds, last_value(CASE WHEN kind = 0 THEN event_id END IGNORE NULLS) OVER w AS approval_id,
        last_value(CASE WHEN kind < 2 THEN event_id END IGNORE NULLS) OVER w AS base_id FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, kind ROWS UNBOUNDED PRECEDING))
    SELECT h.event_id, b.holds AS approved_body, b.approval_id, CASE b.event_type WHEN 'signup' THEN 'approval' ELSE 'restore' END AS baseline
    FROM h JOIN h b ON h.base_id = b.event_id WHERE h.kind = 2 AND b.event_type <> 'error' AND b.approval_id IS NOT NULL AND epoch_us(h.ts) < epoch_us(b.ts) + {int(K.TTL * 86400_000_000)}""")
def answered_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases stand for restoring, errors for removing: later edits are compared with what was restored."""
    body = F.concat(F.lit("v"), F.col("event_id"))
    edits = K.clicks(spark, sf_dir).withColumn("body", body).drop("value")
    approvals = K.approvals(spark, sf_dir).withColumn("body", F.concat(F.lit("v"), F.col("approval_id")))
    answers = K.table(spark, sf_dir, "events").filter("event_type IN ('purchase', 'error')").select(
        F.lit("c").alias("community_id"), F.col("user_id").cast("string").alias("thing_id"), F.col("ts").cast("timestamp").alias("answered_at"), F.when(F.col("event_type") == "purchase", "restore").otherwise("remove").alias("answer")
    )
    return watch.as_answered(edits, approvals, answers, "body", K.TTL).select("event_id", "approved_body", "approval_id", "baseline")


# ---- the log that a stream feeds ------------------------------------------------------------------------------------------
_NEWEST = 3


@query(f"""WITH {K.ASOF_SQL}, s AS (SELECT {_COMMUNITY} AS community_id, user_id::VARCHAR AS thing_id, floor({K._SCORE} * 100 + 0.5) / 100 AS score, edited_at AS detected_at, event_id FROM j WHERE {K._LIVE} AND {K._SCORE} >= 0.55),
    l AS (SELECT community_id, thing_id, max(detected_at) AS detected_at, arg_max(score, detected_at) AS score, arg_max(event_id, detected_at) AS event_id FROM s GROUP BY ALL)
    SELECT community_id, thing_id, event_id, score FROM (SELECT *, row_number() OVER (PARTITION BY community_id ORDER BY detected_at DESC, thing_id) AS rank FROM l) WHERE rank <= {_NEWEST}""")
def log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the stream of late events to the log: every micro-batch is merged into the communities that it touches."""
    both = stateful.encode(_by_community(K.approvals(spark, sf_dir)), "approval", "approved_at").unionByName(stateful.encode(_by_community(K.clicks(spark, sf_dir)), "edit", "edited_at"))
    table = LogTable(spark, f"{shared_dir(spark)}/log-{uuid.uuid4().hex}", _NEWEST, buckets=8)

    def start(stream: DataFrame, path: str):
        edit = F.from_json("edit", "event_id long, value double")
        rows = stateful.joined(stream).select("community_id", "thing_id", F.col("edited_at").alias("detected_at"), edit.alias("e")).select("community_id", "thing_id", "detected_at", "e.event_id", F.expr("least(1.0D, abs(e.value) / 20.0D)").alias("score"))
        hits = rows.filter("score >= 0.55").withColumn("score", log.two_places(F.col("score")))
        return hits.writeStream.foreachBatch(table.write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()

    replay(both, K.TTL, K.NOW, start=start)
    return table.read().select("community_id", "thing_id", "event_id", "score")


# ---- brands as a table ----------------------------------------------------------------------------------------------------
_SKELETON = f"translate(replace(replace(replace(lower({{0}}), 'rn', 'm'), 'vv', 'w'), 'cl', 'd'), '{''.join(dims.LEET)}', '{''.join(dims.LEET.values())}')"


@query(f"""WITH l AS (SELECT DISTINCT label, {_SKELETON.format('label')} AS skeleton FROM (SELECT unnest(string_split(regexp_extract(url, '{K.HOST}', 1), '.')) AS label FROM pages)),
    b AS (SELECT word AS brand, {_SKELETON.format('word')} AS known, row_number() OVER (ORDER BY word) AS ord FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark) WHERE length(word) > 3),
    j AS (SELECT label, brand, ord, CASE WHEN skeleton = known THEN 0 WHEN length(known) >= 4 AND length(skeleton) > length(known) AND length(skeleton) <= length(known) + 14 AND contains(skeleton, known) THEN 1
        WHEN length(known) >= 4 AND abs(length(known) - length(skeleton)) <= 2 AND damerau_levenshtein(skeleton, known) = 1 THEN 2 END AS rule FROM l, b WHERE label || '.net' <> brand || '.com')
    SELECT label, arg_min(brand, (rule, ord)) AS brand, list_extract(['homoglyph', 'combosquat', 'near-edit'], min(rule)::INT + 1) AS kind, (min(rule) = 2)::INT AS distance FROM j WHERE rule IS NOT NULL GROUP BY label""")
def brand_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of pages' hosts against a table of brands that is made of all words of the benchmark; up to one edit, where the
    two engines' distances agree."""
    labels = K.table(spark, sf_dir, "pages").select(F.explode(F.split(F.regexp_extract("url", K.HOST, 1), r"\.")).alias("label")).distinct()
    words = K.table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("label")).filter(F.length("label") > 3).distinct()
    table = words.select(F.col("label").alias("ord"), "label", F.concat("label", F.lit(".com")).alias("domain"))  # in the order of the words
    found = brands.match(labels.select("label", F.concat("label", F.lit(".net")).alias("domain")), table)
    return found.filter("distance < 2").select("label", "brand", "kind", "distance")


# ---- jobs that run once ------------------------------------------------------------------------------------------------------
@query("""SELECT 'c' || user_id AS community_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS installed, 'Driftlens watches approved content for later edits in c' || user_id AS message
    FROM events WHERE event_type IN ('view', 'error') GROUP BY user_id""")
def welcome_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views stand for installs, errors for upgrades: a job run five times over three deliveries of them, the second delivery twice."""
    path = f"{shared_dir(spark)}/welcome-{uuid.uuid4().hex}"
    rows = K.table(spark, sf_dir, "events").select(F.concat(F.lit("c"), "user_id").alias("community_id"), F.expr("CASE event_type WHEN 'view' THEN 'install' WHEN 'error' THEN 'upgrade' ELSE event_type END AS kind"), F.col("ts").cast("timestamp").alias("at"))
    spark.createDataFrame([], events.INSTALLS).write.parquet(f"{path}/in")
    ledger = jobs.Ledger(spark, f"{path}/ledger", jobs.WELCOMES, "community_id")
    installs = events.installs(spark.readStream.schema(events.INSTALLS).parquet(f"{path}/in"))
    middle = rows.filter((F.col("at") >= "2024-01-02") & (F.col("at") < "2024-01-12"))
    for part in (rows.filter(F.col("at") < "2024-01-02"), middle, middle, rows.filter(F.col("at") >= "2024-01-12"), None):
        if part is not None:
            part.write.mode("append").parquet(f"{path}/in")
        jobs.welcome_job(installs, ledger, f"{path}/checkpoint", "Driftlens").awaitTermination()
    return ledger.rows().select("community_id", F.date_format("installed_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("installed"), "message")


@query(f"""WITH a AS (SELECT user_id::VARCHAR AS thing_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS later FROM events WHERE event_type = 'signup'),
    runs AS (SELECT unnest(generate_series(TIMESTAMP '2023-12-31 04:00:00', TIMESTAMP '{K.NOW}', INTERVAL 1 DAY)) AS due),
    first AS (SELECT thing_id, ts, later, min(due) AS due FROM a JOIN runs ON due >= ts + INTERVAL 3 DAY GROUP BY ALL)
    SELECT thing_id, strftime(due, '%Y-%m-%d %H:%M') AS pruned FROM first WHERE later IS NULL OR later > due""")
def prune_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each daily run takes off the watch list."""
    return jobs.prune_runs(K.approvals(spark, sf_dir), K.NOW, K.TTL).select("thing_id", F.date_format("pruned_at", "yyyy-MM-dd HH:mm").alias("pruned"))


# ---- what the dashboard counts and reads ----------------------------------------------------------------------------------
_LOGGED = f"""{K.ASOF_SQL}, s AS (SELECT {_COMMUNITY} AS community_id, user_id::VARCHAR AS thing_id, edited_at AS detected_at, event_id FROM j WHERE {K._LIVE} AND {K._SCORE} >= 0.55),
    l AS (SELECT community_id, thing_id, max(detected_at) AS detected_at, arg_max(event_id, detected_at) AS event_id FROM s GROUP BY ALL)"""


def _logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_community(K.event_log(spark, sf_dir))


@query(f"""WITH {_LOGGED} SELECT community_id, count(*) || CASE WHEN count(*) = 1 THEN ' event' ELSE ' events' END AS shown, greatest(1, ceil(count(*) / 3.0))::INT AS pages FROM l GROUP BY community_id""")
def log_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each community's counter and its number of pages."""
    n = F.count("*")
    return _logged(spark, sf_dir).groupBy("community_id").agg(log.plural(n, "event").alias("shown"), F.greatest(F.lit(1), F.ceil(n / config.PAGE)).cast("int").alias("pages"))


@query(f"WITH {_LOGGED} SELECT thing_id, event_id FROM l ORDER BY detected_at DESC, thing_id LIMIT 25")
def log_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest events, as many as a reader gets who names no limit."""
    return log.recent(_logged(spark, sf_dir)).select("thing_id", "event_id")


@query(f"WITH {K.LINKS_SQL} SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE array_to_string(hrefs, ' ') END AS hrefs, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE len(hrefs) END::INT AS n FROM links")
def stored_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links kept as JSON text and read again; of every fourth document the text is cut off and reads as no links."""
    kept = K.versions(spark, sf_dir).select("doc_id", F.to_json(links.extract_links(F.col("c"))).alias("kept"))
    text = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("["), F.substring("kept", 1, 9))).otherwise(F.col("kept"))
    read = kept.select("doc_id", F.array_sort(events.json_array(text)).alias("hrefs"))
    return read.select("doc_id", F.array_join("hrefs", " ").alias("hrefs"), F.size("hrefs").alias("n"))

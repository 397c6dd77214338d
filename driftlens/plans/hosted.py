"""Queries over what a host delivers: raw events, settings, links in every written form, notices and the log's sink."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.config import Settings, with_defaults
from driftlens.functions import links, sql
from driftlens.operators import log, score
from driftlens.plans import catalogue as K
from driftlens.plans.edits import VERSIONS_SQL, edits, versions
from driftlens.plans.registry import registry
from driftlens.sources import events
from driftlens.streaming import stateful

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
query = registry(QUERIES, ORACLES)

# ---- sources -----------------------------------------------------------------------------------------------------------
#: Raw columns by the document's id, the same in both engines.
RAW = """doc_id, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE 't' || doc_id END AS thing_id, CASE WHEN doc_id % 3 = 0 THEN 'comment' ELSE 'post' END AS type,
    CASE WHEN doc_id % 4 = 0 THEN 'removelink' WHEN doc_id % 3 = 0 THEN 'approvecomment' ELSE 'approvelink' END AS action,
    CASE WHEN doc_id % 19 = 0 THEN NULL ELSE c END AS body, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'https://own.example.org/' || doc_id END AS url,
    CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 2 = 0 END AS is_self, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'm' || doc_id % 9 END AS moderator,
    CASE WHEN doc_id % 6 = 0 THEN NULL ELSE 'a' || doc_id % 8 END AS author, CASE WHEN doc_id % 12 = 0 THEN NULL ELSE 'e' || doc_id % 8 END AS event_author"""
RAW_SQL = f"""{K.LINKS_SQL}, raw AS (SELECT {RAW}, CASE WHEN doc_id % 19 = 0 THEN []::VARCHAR[] ELSE hrefs END AS found FROM links),
    own AS (SELECT *, list_concat(found, CASE WHEN type = 'post' AND NOT coalesce(is_self, true) AND url IS NOT NULL THEN [url] ELSE [] END) AS every FROM raw)"""


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(spark, sf_dir).selectExpr(*_split(RAW), "'c' AS community_id", "CAST(NULL AS STRING) AS title", "CAST(NULL AS STRING) AS permalink", "TIMESTAMP '2024-01-01' AS at")


def _split(columns: str) -> list[str]:
    """A list of SQL columns, none of which holds a comma, one by one."""
    return [c.strip() for c in columns.replace("\n", " ").split(",")]


def _sorted(column: str):
    return F.array_join(F.array_sort(column), " ")


@query(f"""WITH {RAW_SQL} SELECT thing_id, md5(coalesce(body, '')) AS body, array_to_string(list_sort(every), ' ') AS approved_links, coalesce(moderator, 'unknown') AS approved_by, len(every)::INT AS n
    FROM own WHERE action <> 'removelink' AND thing_id IS NOT NULL""")
def source_approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events.approvals(raw(spark, sf_dir))
    return found.select("thing_id", F.md5("approved_body").alias("body"), _sorted("approved_links").alias("approved_links"), "approved_by", F.size("approved_links").alias("n"))


def _edits_sql(kept: str) -> str:
    return f"""WITH {RAW_SQL} SELECT thing_id, md5(coalesce(body, '')) AS body, array_to_string(list_sort(every), ' ') AS hrefs, coalesce(author, event_author, 'unknown') AS author, '' AS permalink
        FROM own WHERE thing_id IS NOT NULL AND {kept}"""


def _edits(spark: SparkSession, sf_dir: str, settings: Settings) -> DataFrame:
    found = events.edits(raw(spark, sf_dir), settings).withColumn("h", F.transform("current_refs", lambda r: r["href"]))
    return found.select("thing_id", F.md5("current_body").alias("body"), _sorted("h").alias("hrefs"), "author", "permalink")


@query(_edits_sql("type = 'post'"))
def source_post_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edits(spark, sf_dir, Settings())


@query(_edits_sql("true"))
def source_comment_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edits(spark, sf_dir, Settings(watch_comments=True))


# ---- links that were approved before, and every written form ------------------------------------------------------------
#: Half of the kinds of edit have their links approved already: what is left is what any link is judged by.
_LINK = f"CASE WHEN doc_id % 24 < 12 THEN {K._LINK} WHEN doc_id % 12 = 3 THEN 0.85 WHEN doc_id % 12 = 4 THEN 0.95 ELSE 0.0 END"


@query(f"WITH {K.LINKS_SQL} SELECT doc_id, round({_LINK}, 6) AS link, array_to_string(CASE WHEN doc_id % 24 < 12 THEN hrefs ELSE [] END, ' ') AS added_links FROM links")
def approved_links_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    had = F.when(F.col("doc_id") % 24 >= 12, F.transform("current_refs", lambda r: r["href"])).otherwise(F.col("approved_links"))
    scored = score.score_drift(edits(spark, sf_dir).withColumn("approved_links", had))
    return scored.select("doc_id", K.r6("link").alias("link"), _sorted("added_links").alias("added_links"))


#: Appended to each document by its id.
FORMS = r"""CASE doc_id % 6 WHEN 0 THEN ' `https://code.example.org/x` ' WHEN 1 THEN chr(10) || '~~~' || chr(10) || 'https://fence.example.org/y' || chr(10) || '~~~' || chr(10)
    WHEN 2 THEN ' in [the manual][M1] it says' || chr(10) || chr(10) || '[m1]: https://ref.example.org/p?q=1.' WHEN 3 THEN ' see [Notes][] too' || chr(10) || '[notes]: <https://ref.example.org/notes>'
    WHEN 4 THEN ' <https://auto.example.org/a/b> and <ftp://files.example.org/c>' ELSE ' [Plan]' || chr(10) || '[plan]: https://ref.example.org/plan' || chr(10) || '[unused]: https://ref.example.org/never' END"""


@query(rf"""WITH f AS (SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, '') || {FORMS}, '~~~[\s\S]*?~~~', '', 'g'), '`[^`]+`', '', 'g') AS x FROM documents),
    d AS (SELECT doc_id, list_concat(regexp_extract_all(x, '<((?:https?|ftp)://[^\s<>]+)>', 1), regexp_extract_all(x, 'https?://[^\s<>]+')) AS every FROM f)
    SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(every, lambda u: regexp_replace(u, '[.]+$', '')))), ' ') AS hrefs FROM d""")
def link_written_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = K.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.expr(FORMS)).alias("x"))
    return docs.select("doc_id", F.array_join(F.array_sort(links.extract_links(F.col("x"))), " ").alias("hrefs"))


@query(rf"""WITH f AS (SELECT doc_id, coalesce(text, '') || {FORMS} AS x FROM documents)
    SELECT doc_id, CASE doc_id % 6 WHEN 2 THEN 'the manual=https://ref.example.org/p?q=1' WHEN 3 THEN 'Notes=https://ref.example.org/notes' WHEN 5 THEN 'Plan=https://ref.example.org/plan' END AS used FROM f WHERE doc_id % 6 IN (2, 3, 5)""")
def link_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is used of the references that a text defines, with its label."""
    docs = K.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.expr(FORMS)).alias("x"))
    used = docs.select("doc_id", F.inline(F.filter(links.reference_links(F.col("x")), lambda r: r["text"] != r["href"])))
    return used.filter("text IN ('the manual', 'Notes', 'Plan')").select("doc_id", F.concat("text", F.lit("="), "href").alias("used"))


# ---- SQL functions ----------------------------------------------------------------------------------------------------
@query(K.ORACLES["lookalike_near_edit"])
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance as a function of Spark SQL."""
    sql.register(spark)
    near = K.names(spark, sf_dir).join(K.brand_table(spark), F.expr(K._NEAR))
    return near.withColumn("distance", F.expr("osa_distance(skeleton, brand)")).filter("distance = 1").select("label", "brand", "distance")


# ---- log, notices, settings ---------------------------------------------------------------------------------------------
def full_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with what notices name."""
    action = F.when(F.col("event_id") % 3 == 0, "notify").when(F.col("event_id") % 3 == 1, "requeue").otherwise("log")
    return K.event_log(spark, sf_dir).withColumns({"action": action, "band": score.band(F.col("score")), "author": F.lit("ann"), "approved_by": F.lit("mo"), "permalink": F.concat(F.lit("/r/c/"), "thing_id")})


_BAND = "CASE WHEN score >= 0.85 THEN 'HIGH' ELSE 'MEDIUM' END"


@query(f"""WITH {K.LOG_SQL} SELECT thing_id, concat_ws(chr(10), '**Approved content drifted (score ' || printf('%.2f', score) || ', severity ' || {_BAND} || ')**', '',
    'A post by u/ann, approved by u/mo, changed after approval and ' || CASE event_id % 3 WHEN 1 THEN 'has been removed and re-queued for review' ELSE 'is still live and flagged for review' END || '.', '',
    '**What changed:**', '- a', '- b', '- c', '- d', '', '[View the post](/r/c/' || thing_id || ')') AS message FROM k WHERE event_id % 3 IN (0, 1)""")
def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.notice(full_log(spark, sf_dir)).select("thing_id", "message")


@query(f"WITH {K.LOG_SQL} SELECT thing_id, strftime(detected_at, '%Y-%m-%d %H:%M:%S.%f') AS detected FROM k WHERE event_id % 3 = 1")
def requeued_things(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.requeued(full_log(spark, sf_dir)).select("thing_id", F.date_format("detected_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("detected"))


@query(f"WITH {K.LOG_SQL} SELECT action, count(*) AS n FROM (SELECT CASE event_id % 3 WHEN 0 THEN 'left up, flagged' WHEN 1 THEN 'removed & re-queued' ELSE 'logged' END AS action FROM k) GROUP BY action")
def action_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return full_log(spark, sf_dir).groupBy(log.action_label(F.col("action")).alias("action")).agg(F.count("*").alias("n"))


_KEPT = f"{K.ASOF_SQL}, s AS (SELECT event_id, 'c' || user_id % 25 AS community_id, {K._SCORE} AS score FROM j)"
_GIVEN = "CASE WHEN n_nationkey % 2 = 1 THEN 0.7 END AS threshold, CASE n_nationkey % 3 WHEN 0 THEN 'notify' WHEN 1 THEN 'shout' END AS action"


@query(f"""WITH {_KEPT}, n AS (SELECT 'c' || n_nationkey AS community_id, {_GIVEN} FROM nation WHERE n_nationkey <> 24)
    SELECT event_id, CASE WHEN action = 'notify' THEN 'notify' ELSE 'requeue' END AS action FROM s LEFT JOIN n USING (community_id) WHERE score >= coalesce(threshold, 0.55)""")
def settings_by_community(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings as a table with gaps, an action that isn't known and a community that isn't listed."""
    threshold, action = _GIVEN.split(", ")
    settings = K.table(spark, sf_dir, "nation").filter("n_nationkey <> 24").selectExpr("'c' || n_nationkey AS community_id", threshold.replace("0.7", "0.7D"), action)
    found = K.joined(spark, sf_dir, 10_000).withColumns({"community_id": F.concat(F.lit("c"), F.col("thing_id").cast("long") % 25), "score": F.expr(K._SCORE.replace("1.0", "1.0D").replace("20.0", "20.0D"))})
    return log.by_settings(found, with_defaults(settings)).select("event_id", "action")


@query(f"WITH {K.ASOF_SQL} SELECT user_id::VARCHAR AS thing_id, round(1 - product(1 - least(1.0, abs(value) / 200.0)), 6) AS score, count(*) AS n FROM j GROUP BY user_id")
def noisy_or_by_thing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy-OR over the rows of each thing."""
    part = F.least(F.lit(1.0), F.abs("value") / 200)
    return K.joined(spark, sf_dir, 10_000).groupBy("thing_id").agg(K.r6(score.noisy_or_of(part)).alias("score"), F.count("*").alias("n"))


@query(K.ORACLES["drift_log_top200"].replace("score, rank", "score"))
def log_sink_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sink fed in two batches, the second of them twice."""
    rows = K.event_log(spark, sf_dir)
    path = f"{stateful.shared_dir(spark)}/log-{uuid.uuid4().hex}"
    write, late = stateful.log_sink(path), F.col("detected_at") >= F.lit("2024-01-16").cast("timestamp")
    for number, part in ((0, rows.filter(~late)), (1, rows.filter(late)), (1, rows.filter(late))):
        write(part, number)
    return stateful.read_log(spark, path).select("thing_id", "event_id", "score")

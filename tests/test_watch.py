import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from driftlens.config import Settings
from driftlens.operators import log, score, watch
from driftlens.sources import events as sources
from driftlens.streaming import stateful

T0 = dt.datetime(2024, 1, 1)
at = lambda hours: T0 + dt.timedelta(hours=hours)
APPROVED = "community_id string, thing_id string, approved_at timestamp, by string"
EDITED = "community_id string, thing_id string, edited_at timestamp, body string"


def tables(spark, n=300, seed=1):
    rng = random.Random(seed)
    a = [("c", f"t{rng.randint(0, 9)}", at(rng.randint(0, 200)), f"m{i}") for i in range(n // 3)]
    a = list({(r[1], r[2]): r for r in a}.values())
    e = [("c", f"t{rng.randint(0, 11)}", at(rng.randint(0, 260)), f"b{i}") for i in range(n)]
    return a, e, spark.createDataFrame(a, APPROVED), spark.createDataFrame(e, EDITED)


def brute(a, e, days):
    out = []
    for c, thing, t, body in e:
        own = [r for r in a if r[1] == thing and r[2] <= t]
        if own and t < max(own, key=lambda r: r[2])[2] + dt.timedelta(days=days):
            latest = max(own, key=lambda r: r[2])
            out.append((thing, t, body, latest[2], latest[3]))
    return sorted(out)


def test_as_of(spark):
    a, e, approvals, edits = tables(spark)
    got = watch.as_of(edits, approvals, 1.5).select("thing_id", "edited_at", "body", "approved_at", "by").collect()
    assert sorted(map(tuple, got)) == brute(a, e, 1.5)
    assert watch.as_of(edits.limit(0), approvals).count() == 0 and watch.as_of(edits, approvals.limit(0)).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    a, e, approvals, edits = tables(spark, 120, 2)
    events = stateful.encode(approvals, "approval", "approved_at").unionByName(stateful.encode(edits, "edit", "edited_at"))
    for k in range(3):  # three files in time order
        events.filter((F.col("at") >= F.lit(at(90 * k))) & (F.col("at") < F.lit(at(90 * (k + 1))))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(stateful.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = stateful.as_of_stream(stream, 1.5, "0 seconds").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    out = spark.read.parquet(f"{tmp_path}/out").select("thing_id", "edited_at", F.get_json_object("edit", "$.body").alias("body"), "approved_at", F.get_json_object("approval", "$.by").alias("by"))
    assert sorted(map(tuple, out.collect())) == brute(a, e, 1.5)


def test_watch_list_and_prune(spark):
    a, _, approvals, _ = tables(spark)
    watched = watch.watch_list(approvals)
    assert watched.count() == len({r[1] for r in a})
    latest = {thing: max(r[2] for r in a if r[1] == thing) for thing in {r[1] for r in a}}
    assert watch.prune(watched, F.lit(at(230)), 2).count() == sum(t > at(230) - dt.timedelta(days=2) for t in latest.values())
    assert {(r["thing_id"], r["by"]) for r in watch.snapshots(approvals).collect()} == {(r[1], r[3]) for r in a if r[2] == latest[r[1]]}


def test_welcome_once(spark):
    installs = spark.createDataFrame([("a",), ("a",), ("b",)], "community_id string")
    assert [r["community_id"] for r in watch.welcome(installs, spark.createDataFrame([("b",)], "community_id string"), "Lens").collect()] == ["a"]


@pytest.fixture(scope="module")
def scored(spark):
    actions = [("c", "p1", "approvelink", "post", "t", "see https://a.org/x", "https://own.com/1", False, None, at(0)), ("c", "p2", "removelink", "post", "t", "b", None, True, "m", at(0)), ("c", "k1", "approvecomment", "comment", None, "hello", None, None, "m", at(1)), ("c", None, "approvelink", "post", "t", "b", None, True, "m", at(0))]
    updates = [("c", "p1", "post", "see https://bit.ly/q now", "https://own.com/1", False, None, None, None, at(5)), ("c", "p2", "post", "new", None, True, "u", None, "/p2", at(5)), ("c", "k1", "comment", "hello [paypal.com](https://evil.ru)", None, None, None, "ev", "/k1", at(6))]
    approvals = sources.approvals(spark.createDataFrame(actions, sources.MOD_ACTIONS))
    assert approvals.count() == 2
    edits = sources.edits(spark.createDataFrame(updates, sources.EDITS), Settings(watch_comments=True))
    return score.score_drift(watch.as_of(edits, approvals)).cache()


def test_from_events_to_log(spark, scored):
    rows = {r["thing_id"]: r for r in log.events(scored, Settings(action="notify")).collect()}
    assert set(rows) == {"p1", "k1"} and rows["p1"]["approved_by"] == "unknown" and rows["k1"]["author"] == "ev" and rows["p1"]["signals"][0].endswith("https://bit.ly/q")
    assert sources.edits(spark.createDataFrame([("c", "k", "comment", "x", None, None, None, None, None, at(1))], sources.EDITS)).count() == 0
    shown = {r["thing_id"]: r for r in log.render(log.events(scored), F.lit(at(30))).collect()}
    assert (shown["p1"]["age"], shown["k1"]["age"], shown["k1"]["badge"], shown["p1"]["action_label"], shown["k1"]["colour"]) == ("1d ago", "1d ago", "COMMENT", "removed & re-queued", "#ff5c5c")
    message = {r["thing_id"]: r["message"] for r in log.notice(log.events(scored)).collect()}["k1"]
    assert "severity HIGH" in message and "- cloaked link" in message and log.requeued(log.events(scored)).count() == 2
    assert log.notice(log.events(scored, Settings(action="log"))).count() == 0


def test_retention_pages_and_sink(spark, tmp_path):
    rows = [("c", f"t{i:03d}", 0.6, at(i % 50)) for i in range(130)] + [("d", "t1", 0.7, at(1))]
    table = spark.createDataFrame(rows, "community_id string, thing_id string, score double, detected_at timestamp")
    order = lambda rs: sorted(rs, key=lambda r: (-r[3].timestamp(), r[1]))
    assert {(r["community_id"], r["thing_id"]) for r in log.retain(table, 40).collect()} == {r[:2] for r in order(rows[:130])[:40]} | {("d", "t1")}
    page = log.page(table.filter("community_id = 'c'"), 1).orderBy("rank").collect()
    assert [r["thing_id"] for r in page] == [r[1] for r in order(rows[:130])[3:6]] and page[0]["has_prev"] and page[0]["has_next"] and page[0]["pages"] == 20
    assert len(log.recent(table).collect()) == 25
    sink, path = stateful.log_sink(f"{tmp_path}/log", 50), f"{tmp_path}/log"
    assert stateful.read_log(spark, path) is None
    sink(table.limit(100), 0)
    newer = table.select("community_id", "thing_id", F.lit(0.9).alias("score"), (F.col("detected_at") + F.expr("INTERVAL 9 DAYS")).alias("detected_at")).filter("thing_id < 't010'")
    for _ in range(2):  # a batch that is run again changes nothing
        sink(newer, 1)
        kept = stateful.read_log(spark, path)
        assert kept.filter("community_id = 'c'").count() == 50 and kept.filter("score = 0.9").count() == 10


def test_json_and_settings(spark):
    df = spark.createDataFrame([('["a","b"]',), ("nonsense",), (None,)], "j string")
    assert [r[0] for r in df.select(sources.json_array(F.col("j"))).collect()] == [["a", "b"], [], []]
    with pytest.raises(ValueError):
        Settings(action="explode")
    with pytest.raises(ValueError):
        Settings(threshold=2)

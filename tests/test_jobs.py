"""Jobs that are run again, or die between steps, and what the daily runs remove."""

import datetime as dt
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from driftlens.sources import events
from driftlens.streaming import jobs
from tests.test_watch import APPROVED, at


def run(spark, path, ledger):
    installs = events.installs(spark.readStream.schema(events.INSTALLS).parquet(f"{path}/in"))
    jobs.welcome_job(installs, ledger, f"{path}/checkpoint", "Lens").awaitTermination()


def put(spark, path, rows):
    spark.createDataFrame(rows, events.INSTALLS).coalesce(1).write.mode("append").parquet(f"{path}/in")


def test_each_community_is_welcomed_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    ledger = jobs.Ledger(spark, f"{path}/ledger", jobs.WELCOMES, "community_id")
    assert ledger.rows().count() == 0 and ledger.pending().count() == 0
    put(spark, path, [("a", "install", at(1)), ("a", "upgrade", at(0)), ("b", "remove", at(1)), (None, "install", at(1))])
    run(spark, path, ledger)
    run(spark, path, ledger)  # nothing new
    assert [(r["community_id"], r["installed_at"]) for r in ledger.rows().collect()] == [("a", at(0))]

    put(spark, path, [("a", "upgrade", at(9)), ("c", "install", at(9)), ("c", "install", at(8))])
    claim = jobs.Ledger.claim
    monkeypatch.setattr(jobs.Ledger, "claim", lambda self, *args: (claim(self, *args), 1 / 0))  # dies when the rows are written
    with pytest.raises(StreamingQueryException):
        run(spark, path, ledger)
    monkeypatch.setattr(jobs.Ledger, "claim", lambda self, *args: 1 / 0)  # dies before
    with pytest.raises(StreamingQueryException):
        run(spark, path, ledger)
    monkeypatch.undo()
    run(spark, path, ledger)
    rows = sorted((r["community_id"], r["installed_at"], r["message"]) for r in ledger.rows().collect())
    assert rows == [("a", at(0), "Lens watches approved content for later edits in a"), ("c", at(8), "Lens watches approved content for later edits in c")]


def test_delivery_is_marked_afterwards(spark, tmp_path):
    ledger = jobs.Ledger(spark, f"{tmp_path}/ledger", "id string, text string", "id")
    ledger.claim(spark.createDataFrame([("x", "1"), ("y", "2"), ("y", "0")], "id string, text string"), 0, "text")
    sent = []
    with pytest.raises(ZeroDivisionError):
        ledger.deliver(lambda rows: (sent.append(sorted(map(tuple, rows.collect()))), 1 / 0), 0)
    ledger.deliver(lambda rows: sent.append(sorted(map(tuple, rows.collect()))), 0)
    ledger.claim(spark.createDataFrame([("x", "again"), ("z", "3")], "id string, text string"), 1, "text")
    ledger.deliver(lambda rows: sent.append(sorted(map(tuple, rows.collect()))), 1)
    ledger.deliver(lambda rows: sent.append(rows.collect()), 2)
    assert sent == [[("x", "1"), ("y", "0")]] * 2 + [[("z", "3")], []]


def test_first_run_after_a_time(spark):
    times = [dt.datetime(2024, 1, 1, 4), dt.datetime(2024, 1, 1, 3, 59, 59, 999999), dt.datetime(2024, 1, 1, 4, 0, 0, 1), dt.datetime(2024, 1, 1), dt.datetime(1969, 12, 31, 23)]
    got = spark.createDataFrame([(t,) for t in times], "t timestamp").select(jobs.due_after(F.col("t"))).collect()
    assert [r[0] for r in got] == [dt.datetime(2024, 1, 1, 4), dt.datetime(2024, 1, 1, 4), dt.datetime(2024, 1, 2, 4), dt.datetime(2024, 1, 1, 4), dt.datetime(1970, 1, 1, 4)]


def test_prune_runs_equal_a_run_a_day(spark):
    rng = random.Random(4)
    a = [("c", f"t{rng.randint(0, 9)}", at(h), f"m{h}") for h in rng.sample(range(400), 60)]
    until, days, watched, gone = at(24 * 20), 2, {}, []
    moments = sorted([(r[2], 0, r) for r in a] + [(dt.datetime(2024, 1, 1, 4) + dt.timedelta(days=d), 1, None) for d in range(20)], key=lambda m: m[:2])
    for t, kind, row in moments:
        if kind == 0:
            watched[row[1]] = t
        else:
            for thing in [k for k, v in watched.items() if v <= t - dt.timedelta(days=days)]:
                gone.append((thing, watched.pop(thing), t))
    got = jobs.prune_runs(spark.createDataFrame(a, APPROVED), until, days).select("thing_id", "approved_at", "pruned_at").collect()
    assert sorted(map(tuple, got)) == sorted(gone) and gone
    assert jobs.prune_runs(spark.createDataFrame([], APPROVED), until).count() == 0

"""The snapshot store: batches, repeats, compaction, new sessions of the catalog, and plans that shuffle no stored row."""

import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from driftlens.storage.drift_log import LogTable, read_log
from driftlens.storage.snapshots import SnapshotStore
from tests.test_watch import APPROVED, at, brute, tables

EDITED = "community_id string, thing_id string, edited_at timestamp, body string"


def store(spark, path, approvals, **kw):
    return SnapshotStore(spark, f"snapshots_{uuid.uuid4().hex}", f"{path}/store", approvals.schema, buckets=4, **kw)


def split(approvals):
    return [approvals.filter((F.col("approved_at") >= F.lit(at(lo))) & (F.col("approved_at") < F.lit(at(hi)))) for lo, hi in ((0, 60), (60, 140), (140, 999))]


def latest(a):
    return {thing: max((r for r in a if r[1] == thing), key=lambda r: r[2])[3] for thing in {r[1] for r in a}}


def test_batches_repeats_and_compaction(spark, tmp_path):
    a, e, approvals, edits = tables(spark)
    kept = store(spark, tmp_path, approvals)
    assert kept.latest().count() == 0 and kept.batches() == []
    parts = split(approvals)
    for k in (0, 2, 1, 1):  # out of order, one of them twice
        kept.upsert(parts[k], k)
    found = lambda: {r["thing_id"]: r["by"] for r in kept.latest().collect()}
    joined = lambda: sorted(map(tuple, kept.as_of(edits, 1.5).select("thing_id", "edited_at", "body", "approved_at", "by").collect()))
    assert kept.rows().count() == len(a) and found() == latest(a) and joined() == brute(a, e, 1.5)
    kept.compact()
    assert kept.batches() == [-1] and kept.rows().count() == len(a) and found() == latest(a) and joined() == brute(a, e, 1.5)
    kept.upsert(parts[1], 1)  # a batch that is run again after it was merged: its rows stand twice and count once
    assert kept.rows().count() > len(a) and found() == latest(a) and joined() == brute(a, e, 1.5)
    kept.compact()
    assert kept.batches() == [-2] and kept.versions().count() == len(a)
    kept.compact(keep_from=str(at(150)))
    late = [r for r in e if r[2] >= at(150)]
    assert kept.rows().count() < len(a) and sorted(r for r in joined() if r[1] >= at(150)) == brute(a, late, 1.5)


def test_compaction_that_stops_half_way(spark, tmp_path, monkeypatch):
    a, e, approvals, _ = tables(spark)
    kept = store(spark, tmp_path, approvals)
    for k, part in enumerate(split(approvals)):
        kept.upsert(part, k)
    write = kept._write
    monkeypatch.setattr(kept, "_write", lambda *args: (write(*args), 1 / 0))
    with pytest.raises(ZeroDivisionError):
        kept.compact()
    monkeypatch.undo()
    assert kept.batches() == [-1, 0, 1, 2] and {r["thing_id"]: r["by"] for r in kept.latest().collect()} == latest(a) and kept.versions().count() == len(a)
    kept.compact()
    assert kept.batches() == [-2] and kept.rows().count() == len(a)


def test_stored_rows_are_not_shuffled(spark, tmp_path):
    a, e, approvals, edits = tables(spark)
    kept = store(spark, tmp_path, approvals)
    for k, part in enumerate(split(approvals)):
        kept.upsert(part, k)
    files = [f for d, _, names in os.walk(tmp_path / "store") for f in names if f.endswith(".parquet") and "batch=" in d]
    assert len(files) <= 3 * 4  # a file for each bucket and batch at most
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(kept.latest()) and "Exchange" not in plan(kept.versions())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shown = plan(kept.as_of(edits))
        assert "SortMergeJoin" in shown and shown.count("Exchange") == 1 and "Exchange hashpartitioning(community_id" in shown  # the edits
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_an_open_store_is_found_again(spark, tmp_path):
    a, _, approvals, _ = tables(spark)
    first = store(spark, tmp_path, approvals)
    first.upsert(approvals, 0)
    again = SnapshotStore(spark, f"other_{uuid.uuid4().hex}", f"{tmp_path}/store", approvals.schema, buckets=4)
    assert again.batches() == [0] and {r["thing_id"]: r["by"] for r in again.latest().collect()} == latest(a)


def test_odd_rows(spark, tmp_path):
    rows = [("c", None, at(1), "nobody"), (None, "t", at(1), "x"), (None, "t", at(2), "y"), ("c", "t", None, "never"), ("c", "t", at(1), None), ("c", "t", at(1), None)]
    approvals = spark.createDataFrame(rows, APPROVED)
    kept = store(spark, tmp_path, approvals)
    kept.upsert(approvals, 0)
    kept.upsert(spark.createDataFrame([("c", "t", at(1), "later batch")], APPROVED), 1)
    assert sorted((r["community_id"] or "", r["by"] or "") for r in kept.latest().collect()) == [("c", "later batch")]
    with pytest.raises(ValueError):
        kept.upsert(approvals, -1)


# ---- the bounded log ------------------------------------------------------------------------------------------------
LOG = "community_id string, thing_id string, score double, detected_at timestamp"


def events(seed, n, communities):
    rng = random.Random(seed)
    times = rng.sample(range(5000), n)
    return [(rng.choice(communities), f"t{rng.randint(0, 30)}", rng.randint(55, 99) / 100, at(t / 10)) for t in times]


def newest(rows, limit):
    last = {}
    for r in sorted(rows, key=lambda r: r[3]):
        last[r[0], r[1]] = r
    out = []
    for c in {r[0] for r in rows}:
        out += sorted((r for r in last.values() if r[0] == c), key=lambda r: (-r[3].timestamp(), r[1]))[:limit]
    return sorted(out, key=repr)


def kept_in(table):
    return sorted(map(tuple, table.read().select("community_id", "thing_id", "score", "detected_at").collect()), key=repr)


def files(path):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(f"{path}/rows") for f in names if f.endswith(".parquet")}


def test_log_batches_in_any_order_of_events(spark, tmp_path):
    table, seen = LogTable(spark, f"{tmp_path}/log", 5, buckets=4), []
    assert table.read() is None and read_log(spark, f"{tmp_path}/log") is None
    table.write(spark.createDataFrame([], LOG), 0)
    assert table.read() is None
    for k in range(1, 7):
        rows = events(k, 60, ["a", "b", "c", "d", None]) if k != 4 else []
        seen += rows
        for _ in range(1 + k % 2):  # some batches are run again
            table.write(spark.createDataFrame(rows, LOG), k)
        assert kept_in(table) == newest(seen, 5)
    assert set(table.manifests()) == {3, 5, 6}  # the fourth was empty, older ones are gone
    named = {(w, b) for m in table.manifests().values() for b, w in m.items()}
    held = {tuple(int(x.split("=")[1]) for x in f.split("/")[-3:-1]) for f in files(f"{tmp_path}/log")}
    assert held == named


def test_untouched_communities_keep_their_files(spark, tmp_path):
    names = [f"c{i}" for i in range(40)]
    table = LogTable(spark, f"{tmp_path}/log", 5, buckets=16)
    table.write(spark.createDataFrame(events(1, 400, names), LOG), 0)
    before = files(f"{tmp_path}/log")
    table.write(spark.createDataFrame([("c7", "t1", 0.9, at(900))], LOG), 1)
    after = files(f"{tmp_path}/log")
    assert all(after[f] == t for f, t in before.items()) and len(after) == len(before) + 1
    assert kept_in(table) == newest(events(1, 400, names) + [("c7", "t1", 0.9, at(900))], 5)


def test_a_failed_batch_is_not_seen_and_comes_again(spark, tmp_path, monkeypatch):
    table = LogTable(spark, f"{tmp_path}/log", 5, buckets=4)
    first, second = events(1, 80, ["a", "b"]), events(2, 80, ["b", "c"])
    table.write(spark.createDataFrame(first, LOG), 0)
    monkeypatch.setattr(spark, "createDataFrame", lambda *a, **k: 1 / 0)  # the manifest isn't written
    rows = spark.range(len(second)).mapInArrow(_rows_of(second), LOG)
    with pytest.raises(ZeroDivisionError):
        table.write(rows, 1)
    assert kept_in(table) == newest(first, 5)
    monkeypatch.undo()
    table.write(rows, 1)
    assert kept_in(table) == newest(first + second, 5)


def _rows_of(rows):
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            part = [rows[i] for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.string()), pa.array([r[1] for r in part], pa.string()), pa.array([r[2] for r in part], pa.float64()), pa.array([r[3] for r in part], pa.timestamp("us", "UTC"))], names=["community_id", "thing_id", "score", "detected_at"])

    return run

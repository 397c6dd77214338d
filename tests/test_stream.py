"""The stream with versioned state against the batch join: late and shuffled events, expiry, state that shrinks."""

import datetime as dt

from pyspark.sql import functions as F

from driftlens.operators import watch
from driftlens.streaming import replay as replays
from driftlens.streaming import stateful
from tests.test_watch import APPROVED, EDITED, at, brute, tables


def both(spark, a, e):
    approvals, edits = spark.createDataFrame(a, APPROVED), spark.createDataFrame(e, EDITED)
    return stateful.encode(approvals, "approval", "approved_at").unionByName(stateful.encode(edits, "edit", "edited_at"))


def said(out):
    rows = out.select("thing_id", "edited_at", F.get_json_object("edit", "$.body").alias("body"), "approved_at", F.get_json_object("approval", "$.by").alias("by"))
    return sorted(map(tuple, rows.collect()))


def ran_out(a, hours, until):
    """Approvals that no later one of the thing follows within hours, and that are over by until."""
    found = []
    for _, thing, t, by in a:
        end = t + dt.timedelta(hours=hours)
        if end <= until and not any(o[1] == thing and t < o[2] < end for o in a):
            found.append((thing, t, end, by))
    return sorted(found)


def test_replay_equals_batch_with_events_out_of_order(spark):
    a, e, _, _ = tables(spark, 240, 5)
    events, until = both(spark, a, e), at(290)
    order = [r["at"] for r in replays.arrivals(events, 24).orderBy("arrived_us").collect()]
    assert sum(x > y for x, y in zip(order, order[1:])) > 50  # they do come out of order
    carried, progress = replays.replay(events, 1.5, until, slices=5)
    assert said(stateful.joined(carried)) == brute(a, e, 1.5)
    expired = stateful.expired(carried).select("thing_id", "approved_at", "expired_at", F.get_json_object("approval", "$.by").alias("by"))
    assert sorted(map(tuple, expired.collect())) == ran_out(a, 36, until)
    fed = [p for p in progress if p.numInputRows]
    assert len(fed) >= 6 and len({p.batchId for p in progress}) >= 6
    held = [p.stateOperators[0].numRowsTotal for p in progress]
    assert max(held) > 20 and held[-1] < max(held) / 4  # what is over is dropped
    assert sum(p.stateOperators[0].numRowsDroppedByWatermark for p in progress) == 0


def feed(spark, path, batches, ttl, lateness):
    spark.createDataFrame([], stateful.EVENTS).write.parquet(f"{path}/in")
    stream = stateful.as_of_stream(spark.readStream.schema(stateful.EVENTS).parquet(f"{path}/in"), ttl, lateness)
    for rows in batches:
        spark.createDataFrame(rows, stateful.EVENTS).coalesce(1).write.mode("append").parquet(f"{path}/in")
        query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(f"{path}/out").select("thing_id", "edited_at", "approved_at", "edit", "approval").orderBy("edited_at", "edit").collect()


def test_a_late_edit_meets_the_approval_of_its_time(spark, tmp_path):
    event = lambda thing, kind, hours, payload: ("c", thing, kind, at(hours), payload)
    batches = [
        [event("t", "approval", 0, "a0"), event("t", "approval", 10, "a10")],
        [event("t", "edit", 5, "e5"), event("t", "edit", 10, "e10")],  # late, and at the time of an approval
        [event("t", "approval", 7, "a7"), event("t", "edit", 8, "e8"), ("c", "t", "edit", None, "no time")],  # an approval that came late itself
        [event("t", "edit", 34, "over"), event("t", "edit", 33.99, "e33"), event("u", "edit", 12, "never approved")],
        [("", "", stateful.TICK, at(200), None)],
        [event("t", "edit", 9, "too late"), ("", "", stateful.TICK, at(300), None)],
    ]
    found = feed(spark, str(tmp_path), batches, 1, "30 hours")
    assert [(r["edit"], r["approval"]) for r in found] == [("e5", "a0"), ("e8", "a7"), ("e10", "a10"), ("e33", "a10")]


def test_empty_table(spark):
    carried, _ = replays.replay(both(spark, [("c", "t", at(0), "m")], []).limit(0), 1, at(10), slices=2)
    assert stateful.joined(carried).count() == 0 and stateful.expired(carried).count() == 0
    assert watch.as_of(spark.createDataFrame([], EDITED), spark.createDataFrame([], APPROVED)).count() == 0

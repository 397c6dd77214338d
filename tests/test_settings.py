"""Settings that change in time, and the answers of moderators, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from driftlens import config
from driftlens.config import Settings, in_force
from driftlens.operators import log, score, watch
from driftlens.sources import events as sources
from tests.test_watch import at

SETTINGS = "community_id string, valid_from timestamp, action string, threshold double, late_edit_hours double, watch_comments boolean"
D = ("requeue", 0.55, 0.0, False)
NAMES = ["action", "threshold", "late_edit_hours", "watch_comments"]


def test_versions_hold_from_their_time(spark):
    versions = [("a", at(0), "notify", 0.3, None, True), ("a", at(10), "shout", None, 5.0, None), ("a", at(10), "log", None, 4.0, None), ("b", None, "log", None, None, None), ("b", at(5), None, 0.9, 1.0, False), (None, at(0), "log", 0.1, 1.0, True)]
    rows = [("a", at(-1)), ("a", at(0)), ("a", at(9)), ("a", at(10)), ("a", at(99)), ("a", None), ("b", at(0)), ("b", at(5)), ("z", at(5)), (None, at(5))]
    got = in_force(spark.createDataFrame(rows, "community_id string, t timestamp"), spark.createDataFrame(versions, SETTINGS), "t").collect()
    first, second, third = ("notify", 0.3, 0.0, True), ("requeue", 0.55, 5.0, False), ("requeue", 0.9, 1.0, False)
    want = dict(zip(rows, [D, first, first, second, second, D, ("log", *D[1:]), third, D, D]))
    assert {(r["community_id"], r["t"]): tuple(r[n] for n in NAMES) for r in got} == want and len(got) == len(rows)


def test_against_a_plain_version(spark):
    rng = random.Random(7)
    versions = [(f"c{rng.randint(0, 5)}", at(rng.randint(0, 90)), rng.choice(["log", "notify", None]), rng.choice([0.2, 0.8, None]), None, rng.random() < 0.5) for _ in range(40)]
    versions = list({r[:2]: r for r in versions}.values())
    rows = [(f"c{rng.choice([0, 0, 0, 1, 2, 3, 4, 5, 6])}", at(rng.randint(-5, 100)), i) for i in range(500)]
    got = in_force(spark.createDataFrame(rows, "community_id string, t timestamp, i long"), spark.createDataFrame(versions, SETTINGS), F.col("t")).collect()

    def holds(community, t):
        own = [v for v in versions if v[0] == community and v[1] <= t]
        v = max(own, key=lambda v: v[1])[2:] if own else (None,) * 4
        return tuple(d if x is None else x for x, d in zip(v, D))

    assert {r["i"]: tuple(r[n] for n in NAMES) for r in got} == {i: holds(c, t) for c, t, i in rows}
    assert in_force(spark.createDataFrame([], "community_id string, t timestamp"), spark.createDataFrame([], SETTINGS), "t").count() == 0


def test_names_that_clash_are_refused(spark):
    with pytest.raises(ValueError):
        in_force(spark.createDataFrame([], "community_id string, action string"), spark.createDataFrame([], SETTINGS), F.lit(None).cast("timestamp"))


def test_settings_take_effect_from_edit_to_log(spark):
    """Comments count only where and while they are watched; late hours, threshold and action are those of the edit's time."""
    versions = [("c", at(0), "notify", 0.3, 2.0, False), ("c", at(20), "log", 0.95, 2.0, True)]
    body = "see https://bit.ly/q now"
    updates = [("c", "p", "post", body, None, True, "u", None, None, at(5)), ("c", "k", "comment", body, None, None, "u", None, None, at(6)), ("c", "k", "comment", body, None, None, "u", None, None, at(21)), ("z", "q", "post", body, None, True, "u", None, None, at(5)), ("c", None, "post", body, None, True, "u", None, None, at(5))]
    actions = [(c, t, "approvelink", "post", None, "see", None, True, "m", at(1)) for c, t in (("c", "p"), ("c", "k"), ("z", "q"))]
    edits = sources.edits_in_force(spark.createDataFrame(updates, sources.EDITS), spark.createDataFrame(versions, SETTINGS))
    assert sorted((r["thing_id"], r["late_edit_hours"], r["action"]) for r in edits.collect()) == [("k", 2.0, "log"), ("p", 2.0, "notify"), ("q", 0.0, "requeue")]
    scored = score.score_drift(watch.as_of(edits, sources.approvals(spark.createDataFrame(actions, sources.MOD_ACTIONS)))).cache()
    late = {r["thing_id"]: any("after approval" in s and s.startswith("edited") for s in r["signals"]) for r in scored.collect()}
    assert late == {"p": True, "k": True, "q": False}
    assert {r["thing_id"]: r["action"] for r in log.events_in_force(scored).collect()} == {"p": "notify", "q": "requeue"}


# ---- answers of moderators ------------------------------------------------------------------------------------------
APPROVED = "community_id string, thing_id string, approved_at timestamp, approval_id long, body string"
EDITED = "community_id string, thing_id string, edited_at timestamp, edit_id long, body string"
ANSWERED = "community_id string, thing_id string, answered_at timestamp, answer string"


def plain(a, e, answers, days):
    out = []
    events = sorted([(t, 0, c, thing, i, body) for c, thing, t, i, body in a] + [(t, 1, c, thing, what, None) for c, thing, t, what in answers] + [(t, 2, c, thing, i, body) for c, thing, t, i, body in e], key=lambda x: x[:2])
    for thing in {x[3] for x in events}:
        holds, by, base = None, None, None
        for t, kind, _, _, what, body in (x for x in events if x[3] == thing):
            if kind == 0:
                holds, by, base = body, what, (t, "approval", body, what)
            elif kind == 1 and what == "restore":
                base = (t, "restore", holds, by) if by is not None else None
            elif kind == 1 and what == "remove":
                base = None
            elif kind == 2:
                holds = body
                if base and (t - base[0]).total_seconds() < days * 86400:
                    out.append((thing, what, body, base[2], base[3], base[0], base[1]))
    return sorted(out, key=repr)


def answered(spark, a, e, answers, days):
    found = watch.as_answered(spark.createDataFrame(e, EDITED), spark.createDataFrame(a, APPROVED), spark.createDataFrame(answers, ANSWERED), "body", days)
    return sorted((tuple(r) for r in found.select("thing_id", "edit_id", "body", "approved_body", "approval_id", "approved_at", "baseline").collect()), key=repr)


def test_restore_and_remove(spark):
    a = [("c", "t", at(0), 1, "first"), ("c", "t", at(50), 2, "second")]
    e = [("c", "t", at(1), 10, "x"), ("c", "t", at(3), 11, "y"), ("c", "t", at(5), 12, "z"), ("c", "t", at(7), 13, "w"), ("c", "t", at(51), 14, "v"), ("c", "u", at(1), 15, "never approved")]
    answers = [("c", "t", at(2), "restore"), ("c", "t", at(4), "ignore"), ("c", "t", at(6), "remove"), ("c", "u", at(0), "restore"), ("c", "t", at(49), None)]
    found = answered(spark, a, e, answers, 30)
    assert found == plain(a, e, answers, 30)
    assert {r[1]: (r[3], r[6]) for r in found} == {10: ("first", "approval"), 11: ("x", "restore"), 12: ("x", "restore"), 14: ("second", "approval")}


def test_answers_against_a_plain_fold(spark):
    rng = random.Random(3)
    times = rng.sample(range(2000), 420)
    thing = lambda: f"t{rng.randint(0, 8)}"
    a = [("c", thing(), at(t / 6), i, f"a{i}" if i % 7 else None) for i, t in enumerate(times[:80])]
    e = [("c", thing(), at(t / 6), i, f"e{i}" if i % 5 else None) for i, t in enumerate(times[80:340])]
    answers = [("c", thing(), at(t / 6), rng.choice(["restore", "remove", "restore", "skip"])) for t in times[340:]]
    # a null body doesn't change what the thing holds
    filled = lambda rows: [(*r[:4], r[4] or "") for r in rows]
    assert answered(spark, filled(a), filled(e), answers, 1.5) == plain(filled(a), filled(e), answers, 1.5)
    assert answered(spark, a, e, [], 1.5) and watch.as_answered(spark.createDataFrame([], EDITED), spark.createDataFrame([], APPROVED), spark.createDataFrame([], ANSWERED), "body").count() == 0
    assert config.TTL_DAYS == 30 and Settings().threshold == 0.55

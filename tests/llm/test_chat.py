import random

import pytest

from driftlens.llm import chat

LOG = "conv_id long, turn long, copy int, seq long, kind string, role string, text string"
PIECES = ["</s>", "[INST]", "[/INST]", "<|", "|>", "\\", "<", "[", "<s>", "<<SYS>>", "é😀", "\n", "ok ", "", "turn|>", "$0", "<|end|>", "\\|", "<\\/s>"]


def fold(events):
    """The messages of one conversation, event by event."""
    messages = {}
    for e in sorted(events, key=lambda e: (e[1], e[2], e[3], e[4])):
        _, turn, copy, _, kind, role, text = e
        m = messages.setdefault((turn, copy), {"role": "", "text": "", "gone": False})
        if kind == "delete":
            m["gone"], m["text"] = True, ""
        elif kind == "delta":
            m["text"] += text or ""
        else:
            m["gone"], m["text"] = False, (text or "") if kind == "edit" else ""
            if kind == "start":
                m["role"] = role or ""
    return [(k, m["role"], m["text"]) for k, m in sorted(messages.items()) if not m["gone"]]


def test_fold_render_and_read_back(spark):
    rng = random.Random(5)
    events = []
    for conv in range(40):
        for turn in range(rng.randint(1, 5)):
            events.append((conv, turn, 1, 0, "start", rng.choice(["user", "assistant", "system<|", None]), None))
            for seq in range(1, rng.randint(1, 7)):
                kind = rng.choice(["delta", "delta", "delta", "edit", "regenerate"] + ["delete"] * (conv % 5 == 0))
                events.append((conv, turn, 1, seq, kind, None, None if rng.random() < 0.1 else "".join(rng.choices(PIECES, k=4))))
    shuffled = events[:]
    rng.shuffle(shuffled)
    rendered = chat.render(chat.reconstruct(spark.createDataFrame(shuffled, LOG).repartition(4)))
    got = {r["conv_id"]: r for r in chat.read_back(rendered).collect()}
    for conv in range(40):
        want = fold([e for e in events if e[0] == conv])
        if not want:
            assert conv not in got
            continue
        r = got[conv]
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(role, text) for _, role, text in want] and r["n_turns"] == len(want)
        assert r["masked"] == [text for _, role, text in want if role == "assistant"]
        spans = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss"]]
        assert [x.replace("\\", "") for x in spans] == [x.replace("\\", "") for x in r["masked"]]
        for control in chat.CONTROL:  # only the template's own are left
            left = r["formatted"].replace(chat.TURN, "").replace(chat.TEXT, "").replace(chat.END, "")
            assert control not in left


@pytest.mark.parametrize("rows", [
    [(1, 0, "user", None), (1, 1, "assistant", "a"), (None, None, None, None), (2, 0, "user", "x"), (2, 0, "user", "x"), (2, 0, "assistant", "b"), (3, 5, "assistant", "long " * 20000)],
    [],
])
def test_tables(spark, rows):
    table = spark.createDataFrame([(*r, "extra", "k") for r in rows], "conv_id long, turn long, role string, text string, copy string, kind string")
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.read_back(chat.render(chat.reconstruct(chat.events_of(table)))).collect()}
    want = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(conv, []).append((role or "", text or ""))
    assert got == want


def test_no_python_in_the_plan(spark):
    table = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.read_back(chat.render(chat.reconstruct(chat.events_of(table))))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

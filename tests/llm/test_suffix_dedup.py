import hashlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from driftlens.llm import common as C
from driftlens.llm import suffix_dedup as S

from . import cases


def brute(texts, length=200):
    starts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if starts[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(t, dtype=np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def test_against_brute_force(spark):
    found = S.remove_repeats(cases.docs(spark)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    pairs = cases.pairs()
    assert cases.key(map(tuple, found)) == cases.key((i, *r) for (i, _), r in zip(pairs, brute([t.encode() for _, t in pairs])))


def test_passages_with_edits(spark):
    rng = np.random.default_rng(4)
    one = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    shared = [one(n) for n in (199, 200, 201, 350, 900)]
    texts = [one(int(rng.integers(0, 300))) + s + one(int(rng.integers(0, 300))) for s in shared for _ in range(3)]
    texts += [shared[4][:450] + "#" + shared[4][451:], shared[3] + shared[3], "ab" * 400, "z" * 500, shared[4][100:600] + one(50) + shared[4][500:]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = S.remove_repeats(df).orderBy("doc_id").select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert [tuple(r) for r in found] == brute([t.encode() for t in texts])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=60), st.integers(1, 20), st.integers(1, 3))
def test_longest_previous_factor(values, length, step):
    values += [0] * length
    data, starts = np.array(values, dtype=np.uint8), np.arange(0, len(values) - length + 1, step)
    before, after = S.longest_previous_factor(data, starts, length)

    def common(i, j):
        return next((k for k in range(length) if values[i + k] != values[j + k]), length)

    at = starts.tolist()
    assert before.tolist() == [max((common(i, j) for j in at if j < i), default=0) for i in at]
    assert after.tolist() == [max((common(i, j) for j in at if j > i), default=0) for i in at]
    whole = S.longest_previous_factor(data, starts, length, whole=True)
    assert ((whole[0] >= length) == (before >= length)).all() and ((whole[1] >= length) == (after >= length)).all()


def test_portions_of_texts(monkeypatch):
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(97, 100, n, dtype=np.uint8)) for n in (3000, 0, 199, 200, 201, 711, 712, 900, 64, 5000)]

    def windows():
        found = []
        for part in S.portions(texts):
            assert sum(len(p) for *_, p in part) <= S.CHUNK + S.LENGTH
            piece, _, _, start, count = S.segments([p for *_, p in part])
            found += [(part[k][0], part[k][1] + s + j) for k, s, c in zip(piece.tolist(), start.tolist(), count.tolist()) for j in range(c)]
        return sorted(found)

    every = [(i, s) for i, t in enumerate(texts) for s in range(len(t) - 199)]
    assert windows() == every
    monkeypatch.setattr(S, "CHUNK", 512)
    S._tables.clear()
    assert windows() == every


def test_hot_anchors_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 3)
    rng = np.random.default_rng(9)
    one = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    phrase, passage = one(90), one(230)
    texts = [one(150) + phrase + one(150) for _ in range(12)] + [one(90) + passage + one(90) for _ in range(12)]
    rows = [*enumerate(texts), (0, texts[0]), (None, texts[1]), (None, texts[1]), (3, texts[2])] + [(40, texts[13])] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = S.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert cases.key(map(tuple, found)) == cases.key((i, *r) for (i, _), r in zip(rows, brute([t.encode() for _, t in rows])))


def test_a_row_repeated_many_times_is_cut_once(spark, monkeypatch):
    """Every copy of a row has the row's name: what is compared for it doesn't grow with them."""
    rng = np.random.default_rng(4)
    one = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    phrase = one(150)
    texts = [one(200) + phrase + one(200) for _ in range(20)]
    rows = [*enumerate(texts)] + [(3, texts[3])] * 10_000
    saved, cut = C.saved, []
    monkeypatch.setattr(C, "saved", lambda df, name: cut.append(found := saved(df, name)) or found if name == "cut" else saved(df, name))
    found = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).select("doc_id", "n_removed", "n_spans").distinct().collect()
    assert cut[0].count() == cut[0].select("anchor", "seg").distinct().count() < 200
    want = brute([t.encode() for t in texts])
    assert {r["doc_id"]: r["n_removed"] for r in found} == {i: len(t) if i == 3 else want[i][1] for i, t in enumerate(texts)}


def test_empty(spark):
    assert S.remove_repeats(cases.docs(spark, [])).collect() == []

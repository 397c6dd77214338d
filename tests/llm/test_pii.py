import itertools
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from driftlens.llm import pii
from driftlens.llm.crf import Tagger

from . import cases


def plain(text):
    """The patterns as they are stated."""
    found = [(*m.span(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(*m.span(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            found.append((*m.span(), 2))
    found += [(*m.span(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], s[2]))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("a1234567890..@@+- ()é%_"), max_size=60))
def test_base_is_as_stated(text):
    assert pii.base_spans(text) == plain(text)


def test_gradient():
    rng = np.random.default_rng(0)
    model = Tagger(10, 4, embed=3, hidden=3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, y = rng.integers(0, 10, (4, 6)), rng.integers(0, 4, (4, 6))
    _, grad = model.gradient(x, y)
    for name, value in model.p.items():
        at = tuple(rng.integers(0, n) for n in value.shape)
        if name == "embed":
            at = (int(x[0, 0]), 1)
        old, e = value[at], 1e-3
        value[at] = old + e
        up = model.gradient(x, y)[0]
        value[at] = old - e
        down = model.gradient(x, y)[0]
        value[at] = old
        assert abs((up - down) / (2 * e) - grad[name][at]) < 2e-3 * max(1, abs(grad[name][at])), name


TEXT = "words and 12.34.56.78 then mail.me@host.example.com or +1 (555) 222-3333 and 4111 1111 1111 1111 in {} words "


def test_operator(spark):
    rows = [(i, (TEXT.format(i) * (1 + i % 3)) if i % 4 else f"nothing here but {i} and 4.0 versions") for i in range(120)] + [(500, None), (501, ""), (None, "a@b.c"), (7, TEXT.format(7)), (502, "x" * 5000 + " q@w.er"), (503, "x@" * 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = pii.train(docs, rounds=12)
    got = pii.find_pii(docs, model).collect()
    assert len(got) == len(rows)
    want = cases.key((i, *(sum(s[2] == k for s in plain(t or "")) for k in range(4)), pii._show(plain(t or ""))) for i, t in rows)
    assert cases.key((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base"]) for r in got) == want
    for r in got:
        assert set(filter(None, r["base"].split(","))) <= set(filter(None, r["spans"].split(",")))
    # the tagger finds again what it was taught, in texts it hasn't seen
    unseen = [TEXT.format(i) for i in range(1000, 1040)]
    found = [set(s) for s in pii.model_spans(model, unseen)]
    assert sum(len(set(plain(t)) & f) for t, f in zip(unseen, found)) >= 0.8 * sum(len(plain(t)) for t in unseen)


def test_tags_round_trip():
    spans = [(2, 5, 0), (5, 9, 0), (12, 13, 3)]
    assert pii.spans_of(pii.tags_of(spans, 15)) == spans


def test_untrained_and_empty(spark):
    docs = cases.docs(spark)
    assert len(pii.find_pii(docs, None).collect()) == len(cases.rows())
    none = cases.docs(spark, [])
    assert pii.train(none) is None and pii.find_pii(none, None).collect() == []


def test_decoding_against_brute_force():
    rng = np.random.default_rng(3)
    model = Tagger(10, 3, embed=3, hidden=3)
    model.p["trans"], model.p["start"] = rng.normal(size=(3, 3)).astype("f4"), rng.normal(size=3).astype("f4")
    scores = [rng.normal(size=(n, 3)).astype("f4") for n in (1, 1, 2, 5, 4, 6)]
    for s, got in zip(scores, model.decode(scores)):
        value = lambda y: model.p["start"][y[0]] + sum(s[t, k] for t, k in enumerate(y)) + sum(model.p["trans"][a, b] for a, b in zip(y, y[1:]))
        assert tuple(got.tolist()) == max(itertools.product(range(3), repeat=len(s)), key=value)


def test_stretches_cover_and_bound(monkeypatch):
    text = ("words " * 40 + "call 12 ") * 6 + "1" * 9000
    starts = pii.window_starts(text)
    held = pii.stretches(starts, len(text))
    covered = {k for s in starts for k in range(s, min(s + pii.WIDTH, len(text)))}
    assert {k for a, b in held for k in range(a, b)} == covered and sum(b - a for a, b in held) == len(covered)
    score = np.random.default_rng(0).normal(size=(20_000, 9)).astype("f4")
    parts = list(pii.shorter(score, 7))
    assert all(len(p) <= pii.STRETCH for _, p in parts) and np.array_equal(np.concatenate([p for _, p in parts]), score) and [a for a, _ in parts] == np.cumsum([7] + [len(p) for _, p in parts])[:-1].tolist()


def test_spans_that_no_pattern_finds(spark):
    """Disguised data of documents that weren't learned from."""
    model = pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id >= 1000 AND text IS NOT NULL").collect()}
    spans = {i: pii.base_spans(t) for i, t in texts.items()}
    hidden = {i: pii.disguised(texts[i], s, i & 1) for i, s in spans.items() if s}
    docs = spark.createDataFrame([(i, t) for i, (t, _) in hidden.items()], "doc_id long, text string").repartition(8)
    right = added = wanted = 0
    for r in pii.find_pii(docs, model).collect():
        want = set(pii._show(hidden[r["doc_id"]][1]).split(",")) - set(r["base"].split(","))
        more = set(filter(None, r["spans"].split(","))) - set(r["base"].split(","))
        right, added, wanted = right + len(want & more), added + len(more), wanted + len(want)
    print(f"right {right}, added {added}, disguised {wanted}")
    assert wanted > 100 and right >= 0.6 * wanted and right >= 0.8 * added

"""Held-out accuracy of the quality scores, the loss against a plain gradient, and the awkward cases."""

import zlib

import numpy as np
import pytest

from driftlens.llm import quality, queries
from tests.llm import cases


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_held_out_accuracy(spark, sf):
    d = f"/root/testdata/{sf}"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = queries.op11_quality(spark, d).collect()
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    test = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    right = [r["predicted"] == labels[r["doc_id"]] for r in test]
    good = [r["score"] for r in test if labels[r["doc_id"]] == 1]
    bad = [r["score"] for r in test if labels[r["doc_id"]] == 0]
    ranked = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    print(sf, len(test), np.mean(right), np.mean(np.array(good) >= 0.3), np.mean(np.array(bad) < 0.3), ranked)
    assert np.mean(right) >= 0.97 and ranked >= 0.98 and np.mean(np.array(good) >= 0.3) >= 0.98


def test_weights_minimise_the_pairwise_loss():
    rng = np.random.default_rng(2)
    better, worse = rng.normal(0.3, 1, (400, 5)), rng.normal(0, 1, (400, 5))
    w = quality.bradley_terry(better, worse, ridge=0.01)

    def loss(w):
        return np.log1p(np.exp(-(better - worse) @ w)).mean() + 0.005 * w @ w

    for k in range(5):
        for step in (1e-4, -1e-4):
            moved = w.copy()
            moved[k] += step
            assert loss(moved) >= loss(w)


def test_quantile_lies_between_what_it_parts():
    worth, weight = np.array([3.0, 1.0, 2.0, 9.0]), np.ones(4)
    assert quality.quantile(worth, weight, 0.25) == 1.5 and quality.quantile(worth, weight, 0.5) == 2.5 and quality.quantile(worth, weight, 0.75) == 6
    assert quality.quantile(worth, np.array([2.0, 1, 1, 4]), 0.5) == 6


def test_features_of_long_texts_are_those_of_their_stretches(monkeypatch):
    text = "Some words, and more of them.\n" * 400
    whole = quality.features(text)
    monkeypatch.setattr(quality, "STRETCH", 600)
    parts = quality.features(text)
    assert np.allclose(whole[13:], parts[13:], atol=0.01) and np.isfinite(parts).all() and np.isfinite(quality.features("x" * 5000)).all()
    assert quality.features("")[0] == quality.features(" \n")[0] == 1 and not quality.features("")[1:].any()


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")


def test_awkward_documents_and_labels(spark):
    docs = cases.docs(spark)
    ids = [i for i, _ in cases.pairs() if i is not None]
    given = [(i, k % 2, 0, "t") for k, i in enumerate(ids)] + [(ids[0], 1, 0, "t"), (ids[0], 0, 0, "t"), (None, 1, 1, "t"), (99999, 1, 0, None), (ids[1], None, 0, None), (ids[2], 7, 0, None)]
    model = quality.train(docs, labels(spark, given))
    rows = quality.score(docs, model).collect()
    assert len(rows) == len(cases.rows()) and all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    assert [tuple(r) for r in quality.score(docs, quality.train(docs, labels(spark, given))).collect()] == [tuple(r) for r in rows]
    assert quality.score(cases.docs(spark, []), model).count() == 0


def test_without_both_labels(spark):
    docs = cases.docs(spark)
    assert {r["score"] for r in quality.score(docs, quality.train(docs, labels(spark, []))).collect()} == {0.5}
    i = next(i for i in range(200) if not held_out(i) and i in [p[0] for p in cases.pairs()])
    assert {r["predicted"] for r in quality.score(docs, quality.train(docs, labels(spark, [(i, 1, 0, None)]))).collect()} == {1}


def test_held_out_labels_do_not_count(spark):
    docs = cases.docs(spark)
    given = [(i, int(i % 3 > 0), 0, None) for i in range(101)]
    turned = [(i, 1 - q if held_out(i) else q, t, x) for i, q, t, x in given]
    a, b = quality.train(docs, labels(spark, given)), quality.train(docs, labels(spark, turned))
    assert np.array_equal(a.weights, b.weights) and a.threshold == b.threshold

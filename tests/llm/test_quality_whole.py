"""The model is learned from all labelled documents: sums over blocks, and an exact threshold."""

import numpy as np

from driftlens.llm import quality, queries
from tests.llm import cases


def test_sums_over_all_pairs_are_those_of_the_differences():
    rng = np.random.default_rng(1)
    good, bad, w = rng.normal(0.4, 1, (7, 4)), rng.normal(0, 1, (5, 4)), rng.normal(0, 1, 4)
    d = (good[:, None] - bad[None]).reshape(-1, 4)
    p = 1 / (1 + np.exp(d @ w))
    assert np.allclose(quality.pair_sums(good, bad, w), np.concatenate(([35], -(d * p[:, None]).sum(axis=0), ((d * (p * (1 - p))[:, None]).T @ d).ravel())))


def test_every_labelled_document_counts(spark, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK", 8)
    rng = np.random.default_rng(2)
    rows = [(i, int(i % 10 > 0), bytearray(rng.normal(i % 10 > 0, 1, len(quality.NAMES)).astype("<f8").tobytes())) for i in range(90)]

    def fitted(rows):
        counts = {k: sum(r[1] == k for r in rows) for k in (0, 1)}
        return quality.fit(spark.createDataFrame(rows, "doc_id long, label int, x binary"), counts, 0.9)

    model = fitted(rows)
    x, y = np.stack([np.frombuffer(bytes(r[2]), dtype="<f8") for r in rows]), np.array([r[1] for r in rows])
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.spread, x.std(axis=0))
    assert np.isclose(model.threshold, quality.quantile(model.worth(x), np.ones(90), 0.1))
    assert (model.worth(x[y == 1]) > model.threshold).mean() > 0.95
    assert np.array_equal(model.weights, fitted(rows).weights)
    for gone in (0, 1, 57, 80):
        assert not np.allclose(model.weights, fitted([r for r in rows if r[0] != gone]).weights, atol=1e-9)


def shuffled(spark):
    """Bytes that this session has written to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    found = sc.statusStore().executorList(True)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_no_text_is_shuffled(spark, tmp_path):
    """Labels that are too large to be broadcast meet features: the texts are 4 MB, the features 200 bytes each."""
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 123, 40_000, dtype=np.uint8)).decode() for _ in range(100)]
    spark.createDataFrame([(i, f"{' ' * (i % 3)}{t[:20]} {t}") for i, t in enumerate(texts)], "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        assert queries.op11_quality(spark, str(tmp_path)).count() == 100
        assert shuffled(spark) - before < 400_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_features_read_once_give_what_two_readings_give(spark):
    docs = cases.docs(spark)
    given = [(i, k % 2, 0) for k, i in enumerate(p[0] for p in cases.pairs())] + [(7, 0, 0), (7, 1, 0), (99999, 1, 0)]
    labels = spark.createDataFrame(given, "doc_id long, quality int, toxic int")
    for found in (labels, labels.filter("quality = 1"), labels.limit(0)):
        once = sorted(quality.train_and_score(docs, found).collect(), key=repr)
        twice = sorted(quality.score(docs, quality.train(docs, found)).collect(), key=repr)
        assert len(once) == len(cases.rows()) and [(r["doc_id"], r["held_out"], r["predicted"]) for r in once] == [(r["doc_id"], r["held_out"], r["predicted"]) for r in twice]
        assert np.allclose([r["score"] for r in once], [r["score"] for r in twice], rtol=1e-9, atol=0)

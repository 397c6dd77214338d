import hashlib
from collections import defaultdict

from driftlens.llm import exact_dedup as X

from . import cases


def brute(pairs):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[cases.low(t)].append(i)
    out = []
    for t, ids in groups.items():
        keep = max(ids, key=lambda i: (i is not None, i or 0))
        digest, first = hashlib.sha256(t.encode()).hexdigest(), True
        for i in ids:
            out.append((i, keep, len(ids), i == keep and first, digest))
            first = first and i != keep
    return cases.key(out)


def got(df):
    return cases.key(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()))


def test_against_brute_force(spark):
    assert got(X.exact_dedup(cases.docs(spark))) == brute(cases.pairs())


def test_many_runs(spark, monkeypatch):
    monkeypatch.setattr(X, "MEMTABLE_ROWS", 3)
    assert got(X.exact_dedup(cases.docs(spark), n_buckets=2)) == brute(cases.pairs())


def weak(data):
    return bytes([len(data) % 3]) * 32


def test_bytes_decide_where_digests_collide(spark):
    pairs = [(i, "abc"[i % 3] * (3 + 3 * (i % 2))) for i in range(30)]
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(4)
    want = [r[:4] for r in brute(pairs)]
    assert cases.key(tuple(r)[:4] for r in X.exact_dedup(df, digest=weak).select("doc_id", "keep_id", "group_size", "kept").collect()) == cases.key(want)


def test_empty(spark):
    assert X.exact_dedup(cases.docs(spark, [])).collect() == []

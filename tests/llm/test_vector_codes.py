"""Codebooks and codes against a plain version with Python integers."""

import hashlib
import math
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from driftlens.llm import queries, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, salt int"


def plain(rows, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], None
    dim = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == dim]
    at, parts = 0, []
    for p in range(4):
        to = at + dim // 4 + (p < dim % 4)
        parts.append((at, to))
        at = to
    books = [[r[1][a:b] for r in kept[:entries]] for a, b in parts]

    def near(v, book):
        return min((sum((x - y) ** 2 for x, y in zip(v, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, (a, b) in enumerate(parts):
            of = defaultdict(list)
            for r in kept:
                of[near(r[1][a:b], books[p])[1]].append(r[1][a:b])
            books[p] = [[sum(c) // len(of[k]) for c in zip(*of[k])] if k in of else e for k, e in enumerate(books[p])]
    found, sums = [], defaultdict(int)
    for i, v, label in kept:
        ds = [near(v[a:b], books[p]) for p, (a, b) in enumerate(parts)]
        found.append((i, "".join(f"{k:02x}" for _, k in ds), min(sum(d for d, _ in ds), 2**63 - 1), label))
        sums[label] += found[-1][2]
    text = ",".join(str(x) for book in books for e in book for x in e)
    return [(i, c, e, min(sums[label], 2**63 - 1)) for i, c, e, label in found], hashlib.sha256(text.encode()).hexdigest()


def run(spark, rows, **kw):
    table = spark.createDataFrame([(*r[:3], "c", 1) for r in rows], SCHEMA).repartition(3)
    found, books = vector_codes.compress(table, **kw)
    return [(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in found.collect()], books and books.sha256()


def same(a, b):
    assert sorted(a[0], key=repr) == sorted(b[0], key=repr)
    assert a[1] == b[1]


def vectors(seed, n, dim, spread=0.3):
    rng = np.random.default_rng(seed)
    return [[float(x) for x in row] for row in rng.normal(0, spread, (n, dim)).astype(np.float32)]


def test_equals_plain_version_with_odd_rows(spark):
    rows = [(i * 7 % 400, v, i % 5 or None) for i, v in enumerate(vectors(1, 320, 8))]
    rows += [(-3, None, 1), (-2, [None] * 8, 1), (-1, [float("nan")] + [0.0] * 7, 2), (500, [float("-inf")] + [0.0] * 7, 2), (501, [0.5] * 7, 3), (502, [], 3)]
    rows += [(None, [0.25] * 8, None)] * 2 + [rows[3]] * 40 + [(rows[3][0], [0.125] * 8, 4)]
    same(run(spark, rows), plain(rows))
    same(run(spark, rows, entries=3, rounds=2), plain(rows, 3, 2))


@pytest.mark.parametrize("dim", [0, 1, 3, 6])
def test_lengths_that_four_parts_do_not_divide(spark, dim):
    rows = [(i, v, 1) for i, v in enumerate(vectors(dim, 30, dim))]
    same(run(spark, rows, entries=4), plain(rows, 4))


@pytest.mark.parametrize("factor", [40.0, 1e5, 1e9, 1e30])
def test_large_components_stay_exact(spark, factor):
    rows = [(i, [float(np.float32(x * factor)) for x in v], i % 2) for i, v in enumerate(vectors(5, 40, 8))]
    same(run(spark, rows, entries=5), plain(rows, 5))


def test_empty_table_and_ties(spark):
    assert run(spark, []) == ([], None)
    assert run(spark, [(1, None, 1)]) == ([], None)
    rows = [(i, [0.5] * 8, 1) for i in range(20)]
    found = run(spark, rows)
    same(found, plain(rows))
    assert {r[1] for r in found[0]} == {"00000000"}


def test_many_blocks_and_a_label_that_holds_most_rows(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK", 64)
    rows = [(i, v, 7 if i % 10 else 1) for i, v in enumerate(vectors(9, 500, 8))]
    same(run(spark, rows, entries=16), plain(rows, 16))


def test_query_equals_its_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    sql = con.execute(f"SELECT vec_id, code, error, label_error, codebooks_sha256 FROM ({queries.ORACLES['op12_vector_codes']}) ORDER BY 1").fetchall()
    found = queries.op12_vector_codes(spark, d)
    assert sorted(tuple(r) for r in found.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()) == sql

import itertools
import re
import time

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from driftlens.llm import components, golay, simhash

from . import cases


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", cases.low(text))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(prints):
    """Smallest id reachable; prints: (id, fingerprint)."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(prints)), 2):
        if (prints[a][1] ^ prints[b][1]).bit_count() <= 2:
            parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(prints):
        r = root(k)
        least[r] = i if r not in least or least[r] is None else least[r] if i is None else min(i, least[r])
    return [least[root(k)] for k in range(len(prints))]


def test_against_brute_force(spark):
    pairs = [(i, t) for i, t in cases.pairs() if i is not None]
    prints = [(i, fingerprint(t)) for i, t in pairs]
    got = simhash.near_dedup(cases.docs(spark, [r for r in cases.rows() if r[0] is not None])).collect()
    assert cases.key(map(tuple, got)) == cases.key((i, f"{p:016x}", c) for (i, p), c in zip(prints, brute(prints)))
    assert len(simhash.near_dedup(cases.docs(spark)).collect()) == len(cases.rows())


def test_keys_meet_within_the_radius():
    base = np.random.default_rng(0).integers(0, 2**64, 6, dtype=np.uint64)

    def keys(fp):
        part = [(fp >> np.uint64(a) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in simhash.SEGMENTS]
        return [(part[i], golay.nearby(part[(i + 1) % 3])) for i in range(3)]

    for n in range(3):
        for bits in itertools.combinations(range(64), n):
            met = np.zeros(len(base), dtype=bool)
            for (a, x), (b, y) in zip(keys(base), keys(base ^ np.uint64(sum(1 << k for k in bits)))):
                met |= (a == b) & (x[:, :1] == y).any(axis=1)
            assert met.all(), bits


def test_forest_joins_what_is_linked(monkeypatch):
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 2**9, 300, dtype=np.uint64) << np.uint64(20) | rng.integers(0, 2, 300, dtype=np.uint64) << np.uint64(50))
    want = brute(list(enumerate(fps.tolist())))
    for most in (4096, 8):
        monkeypatch.setattr(simhash, "SCAN", most)
        links = simhash.forest(fps)
        assert all((int(fps[a]) ^ int(fps[b])).bit_count() <= 2 for a, b in links)
        parent = list(range(len(fps)))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            parent[max(root(a), root(b))] = min(root(a), root(b))
        least = {}
        for k in range(len(fps)):
            least.setdefault(root(k), k)
        assert [least[root(k)] for k in range(len(fps))] == want


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)).filter(lambda e: e[0] != e[1]), max_size=60))
def test_components(spark, links):
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    least = {n: n for e in links for n in e}
    for _ in range(61):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert got == least


def test_long_chain(spark):
    chain = [(i, i + 1) for i in range(300)]
    assert {r["component"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()} == {0}


def test_empty(spark):
    assert simhash.near_dedup(cases.docs(spark, [])).collect() == []


def test_null_ids_link(spark):
    near = "one two three four five six seven eight nine ten"
    prints = {}
    for i, w in enumerate(["ten", "ten eleven", "ten eleven twelve"] + [f"ten word{k}" for k in range(400)]):
        prints[i] = (near.replace("ten", w), simhash.fingerprint(simhash.shingle_hashes(near.replace("ten", w).encode())))
    chain = next(((a, b, c) for a in prints for b in prints for c in prints if len({prints[k][1] for k in (a, b, c)}) == 3 and (prints[a][1] ^ prints[b][1]).bit_count() <= 2 and (prints[b][1] ^ prints[c][1]).bit_count() <= 2 and (prints[a][1] ^ prints[c][1]).bit_count() > 2), None)
    assert chain
    rows = [(1, prints[chain[0]][0]), (None, prints[chain[1]][0]), (3, prints[chain[2]][0]), (None, "alone among others")]
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (None, 1), (3, 1), (None, None)}


def test_many_fingerprints_under_one_exact_segment():
    rng = np.random.default_rng(3)
    fps = np.unique(rng.integers(0, 1 << 42, 100_000, dtype=np.uint64) << np.uint64(22) | np.uint64(77))
    fps = np.unique(np.concatenate((fps, fps[:500] ^ np.uint64(1 << 40 | 1 << 30))))
    began = time.time()
    links = simhash.forest(fps)
    assert time.time() - began < 20
    want = {(int(f), int(f ^ np.uint64(1 << 40 | 1 << 30))) for f in fps[np.isin(fps ^ np.uint64(1 << 40 | 1 << 30), fps)]}
    assert want and all(int(fps[i] ^ fps[j]).bit_count() <= 2 for i, j in links)
    group = {}

    def root(x):
        while group.get(x, x) != x:
            x = group[x]
        return x

    for i, j in links:
        group[root(int(fps[i]))] = root(int(fps[j]))
    assert all(root(a) == root(b) for a, b in want)


def test_hot_keys_are_narrowed(spark, monkeypatch):
    rng = np.random.default_rng(5)
    alike = rng.integers(0, 1 << 9, 400, dtype=np.uint64) << np.uint64(30) | rng.integers(0, 2, 400, dtype=np.uint64) << np.uint64(63)
    fps = np.unique(np.concatenate((alike, rng.integers(0, 2**64, 50, dtype=np.uint64))))
    want = brute(list(enumerate(fps.tolist())))
    nodes = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    for hot in (4096, 64):
        monkeypatch.setattr(simhash, "HOT", hot)
        spread = simhash._spread(nodes.mapInArrow(simhash._keys, simhash.KEYED))
        largest = spread.groupBy("key").count().agg({"count": "max"}).first()[0]
        assert largest <= 64 if hot == 64 else largest > 64
        links = [(r["a"], r["b"]) for r in simhash.near_links(nodes).collect()]
        assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in links)
        at = {int(f): k for k, f in enumerate(fps.view(np.int64))}
        parent = list(range(len(fps)))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            x, y = root(at[a]), root(at[b])
            parent[max(x, y)] = min(x, y)
        assert [root(k) for k in range(len(fps))] == want


def test_the_limit_of_a_hot_key_does_not_grow_with_the_table(spark, monkeypatch):
    """One key holds one in a thousand of all rows, which is over the limit."""
    monkeypatch.setattr(simhash, "HOT", 30)
    rng = np.random.default_rng(8)
    alike = np.unique(rng.integers(0, 1 << 12, 60, dtype=np.uint64)) << np.uint64(45)
    fps = np.unique(np.concatenate((alike, rng.integers(0, 2**64, 60_000, dtype=np.uint64))))
    nodes = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long").repartition(4)
    rows = nodes.mapInArrow(simhash._keys, simhash.KEYED)
    assert rows.groupBy("key").count().agg({"count": "max"}).first()[0] > 30
    assert simhash._spread(rows).groupBy("key").count().agg({"count": "max"}).first()[0] <= 30

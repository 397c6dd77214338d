import random
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from driftlens.llm import common as C
from driftlens.llm import decontaminate as D

from . import cases

rng = random.Random(9)
VOCABULARY = [f"w{i}é" if i % 9 == 0 else f"w{i}" for i in range(400)]
ITEMS = [" ".join(rng.choice(VOCABULARY) for _ in range(n)) for n in (3, 5, 6, 20, 20, 33, 60)]


def text(item, edit):
    words = item.split()
    if edit == "change":
        words[len(words) // 2] = "other"
    if edit == "insert":
        words.insert(2, "other")
    if edit == "end":
        words[-1] = "other"
    noise = [" ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(0, 50))) for _ in range(2)]
    return f"{noise[0]} {' '.join(words).upper() if edit == 'upper' else ' '.join(words)}. {noise[1]}"


def shingles(words):
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)])


def brute(docs, items):
    found = set()
    for i, t in docs:
        words = C.words_of((t or "").encode())
        for j, item in items:
            own = C.words_of((item or "").encode())
            if not own or not words:
                continue
            b = shingles(own)
            for s in range(max(1, len(words) - len(own) + 1)):
                a = shingles(words[s : s + len(own)])
                both = sum((a & b).values())
                if both / (sum(a.values()) + sum(b.values()) - both) >= 0.8:
                    found.add((i, j))
    return found


def test_against_brute_force(spark):
    docs = [(k, text(item, edit)) for k, (item, edit) in enumerate((i, e) for i in ITEMS for e in ("same", "upper", "change", "insert", "end"))]
    docs += [(1000, None), (1001, ""), (1002, ITEMS[3] + " " + ITEMS[3]), (1003, ITEMS[3] + " " + ITEMS[4]), (1004, " ".join(VOCABULARY * 20)), (1004, ITEMS[6])]
    items = [*enumerate(ITEMS), (90, None), (91, "!"), (None, "x"), (3, ITEMS[3])]
    found = D.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), items=3).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == brute(docs, [x for x in items if x[0] is not None])
    assert len(found) == len({(r["doc_id"], r["item_id"]) for r in found})


def test_index_holds_everything_within_the_radius():
    index = D.Index.build(list(enumerate(ITEMS)))
    for n in range(300):
        fingerprint = index.items[n % len(index.items)][3]
        for b in rng.sample(range(64), rng.randint(0, 24)):
            fingerprint ^= 1 << b
        for k, length in enumerate(index.lengths):
            want = [(i, d) for i, item in enumerate(index.items) if item[1] - 4 == length and (d := (item[3] ^ fingerprint).bit_count()) <= D.RADIUS]
            assert index.within(k, np.array([fingerprint], dtype=np.uint64)) == [want]


def test_recall_of_the_radius():
    """Windows that are similar enough, by edits of every kind, are all within the radius."""
    one, far = random.Random(77), []
    for n in [20, 40, 60, 90, 150, 300] * 120:
        own = [f"v{one.randrange(3000)}" for _ in range(n)]
        words = own[:]
        for _ in range(one.randint(1, 1 + n // 40)):
            k = one.randrange(len(words) - 6)
            words[k : k + one.randint(0, 2)] = [f"u{one.randrange(999)}" for _ in range(one.randint(0, 2))]
            if one.random() < 0.3:
                words[k:k] = words[k : k + 6]
        a, b = (shingles(w) for w in (words[:n], own))
        both = (a & b).total()
        if both / (a.total() + b.total() - both) >= 0.8:
            x, y = (D.simhash(D.shingles(D.hashes([w.encode() for w in v]))) for v in (words[:n], own))
            far.append((x ^ y).bit_count())
    assert len(far) > 150 and max(far) <= D.RADIUS


def test_a_preface_that_all_items_share():
    one = random.Random(5)
    preface = [f"p{k}" for k in range(40)]
    items = [(k, " ".join(preface + [f"v{one.randrange(10**6)}" for _ in range(20 + k % 5)])) for k in range(300)]
    index = D.Index.build(items)
    text = " ".join(preface * 15).encode()
    began = time.time()
    assert index.search(C.words_of(text)) == [] and time.time() - began < 2
    assert [h[0] for h in index.search(C.words_of(f"x y {items[7][1]} z".encode()))] == [7]


def test_empty(spark):
    none, some = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, ITEMS[4])], "item_id long, text string")
    assert D.find_leaks(cases.docs(spark), none).collect() == [] and D.find_leaks(cases.docs(spark, []), some).collect() == []


def test_parts_in_another_order():
    one = random.Random(31)
    word = lambda n: [f"v{one.randrange(10**6)}" for _ in range(n)]
    items, docs = [], []
    for n in (70, 130, 200, 400):
        own = word(n)
        for cut in (n // 10, n // 2, n - 66):
            for left_out, put_in in ((0, 0), (0, n // 40), (n // 40, n // 40), (n // 30, n // 20)):
                docs.append((len(docs), " ".join(word(150) + own[cut + left_out :] + word(put_in) + own[:cut] + word(150))))
        third = n // 3
        docs.append((len(docs), " ".join(word(20) + own[2 * third :] + own[third : 2 * third] + own[:third] + word(20))))
        items.append((len(items), " ".join(own)))
        docs.append((len(docs), " ".join((own * 3)[n // 4 : -(n // 3)])))
        docs.append((len(docs), " ".join(own[5:])))  # shorter than the item
    items.append((len(items), " ".join(items[1][1].split()[:40] * 3)))
    docs.append((len(docs), items[-1][1] + " " + items[-1][1]))
    index = D.Index.build(items)
    found = {(i, hit[0]): hit for i, t in docs for hit in index.search(C.words_of(t.encode()))}
    assert set(found) == brute(docs, items) and len(found) > 40
    for (i, j), (_, start, n, _, similar) in found.items():
        words, own = docs[i][1].split(), items[j][1].split()
        near = lambda s: sum((shingles(words[s : s + len(own)]) & shingles(own)).values())
        most = max(range(max(1, len(words) - len(own) + 1)), key=near)  # the first of the best
        whole = shingles(words[most : most + len(own)]).total() + shingles(own).total()
        assert (start, n, similar) == (most, min(len(own), len(words)), near(most) / (whole - near(most)))


def test_sliding_fingerprints():
    s = D.shingles(D.hashes(C.words_of(" ".join(ITEMS).encode())))
    for length in (1, 2, 7, len(s)):
        assert D.simhashes(s, length).tolist() == [D.simhash(s[k : k + length]) for k in range(len(s) - length + 1)]


def test_many_items_in_one_reading(spark):
    """20,000 items, joined: the same rows as from one index of those that can occur, for whole, cut and changed items."""
    one = random.Random(41)
    item = lambda: " ".join(f"w{one.randrange(4000)}" for _ in range(one.choice([2, 4, 5, 9, 30, 60])))
    items = [(k, item()) for k in range(20_000)]
    docs, used = [], set()
    for k in range(150):
        used.add(n := one.randrange(20_000))
        own = items[n][1].split()
        if k % 3 == 0 and len(own) > 20:
            own[len(own) // 2] = "changed"
        if k % 5 == 0:
            own = own[: max(1, len(own) * 4 // 5)]
        docs.append((k, " ".join([f"w{one.randrange(4000)}" for _ in range(40)] + own + [f"w{one.randrange(4000)}" for _ in range(one.randint(0, 30))])))
    docs += [docs[3], docs[3], (None, docs[4][1]), (None, "clean text of nobody"), (500, None), (501, "")]
    df, table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    found = D.find_leaks(df, table).collect()
    index = D.Index.build([(k, t) for k, t in items if k in used or k % 100 == 0 or len(t.split()) < 5])
    want = [(i, *hit) for i, t in docs for hit in index.search(C.words_of((t or "").encode()))]
    assert cases.key(map(tuple, found)) == cases.key(want) and len(want) > 60
    clean = D.keep_clean(df.withColumn("row", F.lit(1)), table)
    leaks = {(i, t) for i, t in docs if index.search(C.words_of((t or "").encode()))}
    assert cases.key((r["doc_id"], r["text"]) for r in clean.collect()) == cases.key(d for d in docs if d not in leaks) and clean.columns == ["doc_id", "text", "row"]


def test_listed_codes_can_not_all_be_missing():
    assert D.listed([(1, 10, 1), (5, 11, 3), (2, 12, 1)], 5) == [10, 12] and D.listed([(9, 1, 7)], 7) == [1]
    one = random.Random(8)
    for _ in range(2000):
        own = Counter(one.choices(range(30), k=one.randint(1, 40)))
        other = own - Counter(one.sample(sorted(own.elements()), one.randint(0, own.total() // 3))) + Counter(one.choices(range(30, 60), k=one.randint(0, 8)))
        both = (own & other).total()
        if both / (own.total() + other.total() - both) >= 0.8:
            assert set(D.listed([(one.randint(1, 3), c, t) for c, t in own.items()], own.total())) & set(other)

"""Words, near words, forms and roots against a plain version that compares all words with all."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from driftlens.llm import queries, spelling
from tests.llm import cases

LETTERS = "abcdeéüØ÷"


def apart(a, b):
    """Whether one code point inserted, deleted or replaced turns a into b."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = cases.low(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 6 and k >= 5}
    near = {w: [v for v in n if apart(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else -1) for w in n)


def run(spark, rows):
    data = [(i, t, "en", "s", 1, "r", 2, "b", "n") for i, t in rows]
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"]) for r in spelling.variants(cases.docs(spark, data)).collect())


def near_words(rng, n, letters=LETTERS):
    """Words of which many are one or two edits from another."""
    found = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 9))) for _ in range(n // 4)]
    while len(found) < n:
        w = list(rng.choice(found))
        at, kind = rng.randrange(len(w)), rng.randrange(3)
        if kind == 0:
            w[at] = rng.choice(letters)
        elif kind == 1:
            w.insert(at, rng.choice(letters))
        else:
            del w[at]
        found.append("".join(w))
    return found


def corpus(seed, n=300, letters=LETTERS):
    rng = random.Random(seed)
    rows = []
    for i, w in enumerate(near_words(rng, n, letters)):
        times = rng.choice([1, 4, 5, 6, 30, 200])
        rows.append((i, "; ".join(rng.choice([w, w.capitalize(), w]) for _ in range(times))))
    return rows + [(n, "chainword " * 200), (n + 1, "Chainwird " * 35), (n + 2, "chsinwird " * 6)]


@pytest.mark.parametrize("seed,letters", [(1, LETTERS), (2, "ab"), (3, "abcdefghijklmnop")])
def test_equals_comparing_all_words(spark, seed, letters, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", 4)
    rows = corpus(seed, letters=letters)
    found = run(spark, rows)
    assert found == plain(rows)
    assert sum(r[4] for r in found) > 100 and any(r[1] for r in found) and any(r[2] != r[1] and r[1] for r in found)


def test_awkward_documents(spark):
    rows = cases.pairs() * 5 + [(None, "Zeitgeist zeitgeist ZEITGEIST zeitgeißt " * 40), (5, None)]
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == []


def test_a_word_of_any_length_and_texts_in_stretches(spark, monkeypatch):
    long = "abcdefgh" * 500
    rows = [(i, f"{long} x {long}y, {long[:-1]}.") for i in range(6)]
    expected = plain(rows)
    assert run(spark, rows) == expected and [r[4] for r in expected] == [1, 2, 1]
    text = " ".join(random.Random(4).choices(near_words(random.Random(4), 600), k=4000))

    def words(size):
        monkeypatch.setattr(spelling, "STRETCH", size)
        found = Counter()
        spelling.add_words(found, 3, text)
        return +found

    once = Counter()
    for word in map(cases.low, re.findall("[A-Za-zÀ-ÿ]+", text)):
        h = zlib.crc32(f"3:{word}".encode())
        once[word if h % 199 else word[: h % len(word)] + word[h % len(word) + 1 :]] += 1
    want = Counter({w: n for w, n in once.items() if len(w) >= 6})
    assert words(7) == words(300) == words(1 << 20) == want and any(zlib.crc32(f"3:{cases.low(w)}".encode()) % 199 == 0 for w in set(text.split()))
    assert list(spelling.stretches("")) == []


def test_near_words_share_a_key():
    """What the join relies on, over all sorts of words with few letters, where bigrams repeat."""
    rng = random.Random(11)
    for letters in ("ab", "abc", "abcdef"):
        words = sorted(set(near_words(rng, 500, letters)))
        counts = Counter(b for w in words for b in spelling.bigrams(w))
        ranks = {b: k for k, b in enumerate(sorted(counts, key=lambda b: (counts[b], b)))}
        found = {w: spelling.roles(w, ranks) for w in words}
        near = [(a, b) for a in words for b in words if len(a) <= len(b) and apart(a, b)]
        assert len(near) > 300
        for a, b in near:
            assert found[a][0] & found[b][0] if len(a) == len(b) else found[a][1] & found[b][2], (a, b)


def test_a_common_key_is_divided(spark):
    """Words that all start alike and otherwise hold common bigrams: their key is one, its blocks are many."""
    rng = random.Random(6)
    words = sorted({"zq" + "".join(rng.choice("ab") for _ in range(10)) for _ in range(600)})
    rows = [(i, " ".join([w] * 5)) for i, w in enumerate(words)]
    spelling_block, spelling.BLOCK = spelling.BLOCK, 50
    try:
        assert run(spark, rows) == plain(rows)
    finally:
        spelling.BLOCK = spelling_block


def test_query_equals_its_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    names = "word, form, root, n, n_near, form_n"
    sql = con.execute(f"SELECT {names} FROM ({queries.ORACLES['op13_spelling_variants']}) ORDER BY word").fetchall()
    found = sorted((tuple(r) for r in queries.op13_spelling_variants(spark, d).select(*names.split(", ")).collect()), key=lambda r: r[0].encode())
    assert sorted(sql, key=lambda r: r[0].encode()) == found and found

from driftlens.llm import language as G

from . import cases

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    found = [r for r in G.identify(docs, G.train(docs)).collect() if r["held_out"]]
    assert len(found) > 150 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in found) >= 0.97 * len(found)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_cases(spark):
    docs = cases.docs(spark)
    model = G.train(docs)
    found = G.identify(docs, model).collect()
    assert len(found) == len(cases.rows())
    pred = {}
    for r in found:
        pred.setdefault(r["doc_id"], set()).add(r["lang_pred"])
    for i, t in cases.pairs():
        if not any(c.isalpha() for c in t):
            assert "und" in pred[i]
    assert {p for v in pred.values() for p in v} <= {"en", "fr", "und"}


def test_without_labels(spark):
    docs = cases.docs(spark, [(1, "some text", None, *[None] * 6)])
    assert [tuple(r) for r in G.identify(docs, G.train(docs)).select("lang_pred", "score").collect()] == [("und", 0.0)]
    assert G.identify(cases.docs(spark, []), G.train(cases.docs(spark, []))).collect() == []


def test_unlisted_languages_and_families():
    x = G.np.stack([G.vector(t) for t in (b"aaa bbb ", b"ccc ddd ", b"eee fff ") for _ in range(20)])
    model = G.fit(x, ["q1"] * 20 + ["en"] * 20 + ["de"] * 20)
    assert model.families == {"germanic": ["de", "en"], "only q1": ["q1"]}
    assert [model.predict(G.vector(t))[0] for t in (b"aaa bbb ", b"ccc ddd ", b"eee fff ")] == ["q1", "en", "de"]


def test_vote_against_brute_force():
    rng = G.np.random.default_rng(1)
    names = [f"k{i}" for i in range(5)]
    machines = {(a, b): rng.normal(size=7).astype("f4") for i, a in enumerate(names) for b in names[i + 1 :]}
    model = G.Model({"only": names}, machines)
    for _ in range(200):
        x = rng.normal(size=6).astype("f4")
        duel = {(a, b): float(w[:-1] @ x + w[-1]) for (a, b), w in machines.items()}
        margin = lambda k: sum(m if a == k else -m for (a, b), m in duel.items() if k in (a, b))
        wins = lambda k: sum((m >= 0) == (a == k) for (a, b), m in duel.items() if k in (a, b))
        assert model.choose(names, x)[0] == max(names, key=lambda k: (wins(k), margin(k), k))


def test_numbers_are_not_letters():
    assert not any(map(G.has_letter, ("½ ² Ⅷ ① 3 _", "", "...", "🙂")))
    assert all(map(G.has_letter, ("3 a", "字", "é", "ª")))

"""The stages against plain Python versions of what each decides."""

import random

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from driftlens.llm import language

from . import cases
from .test_decontaminate import brute as leaks
from .test_simhash import brute as components
from .test_simhash import fingerprint


def small(spark, tmp_path):
    rng = random.Random(11)
    items = [" ".join(f"q{rng.randint(0, 99)}" for _ in range(n)) for n in (12, 30)]
    data = cases.rows()
    data += [(2000 + i, cases.prose(rng, 20) + f" {items[i % 2]} " + cases.prose(rng, 20), "en", "s", 1, "r", 5, "b", "n") for i in range(4)]
    long = cases.prose(rng, 4000)
    data += [(3000 + i, long + f" tail{i}", "fr", "s", 1, "r", 5, "b", "n") for i in range(3)]
    sf = str(tmp_path)
    clash = {c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in ("_own", "_n", "id", "sha", "_ID", "root", "key")}
    cases.docs(spark, data).withColumns(clash).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf, items


def rows(df):
    for c in ("_own", "_n", "id", "sha", "_ID", "root", "key"):  # what the caller has stays
        assert df.filter(~F.col(c).eqNullSafe(F.concat(F.lit(c), F.col("doc_id").cast("string")))).isEmpty()
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_every_stage(spark, tmp_path):
    sf, items = small(spark, tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "simhash_near_dedup", "decontamination", "packing"]

    model = language.train(docs)
    before = rows(docs)
    docs = stages["language_id"](spark, docs, sf)
    want = [(i, t) for i, t in before if t and language.has_letter(t) and model.predict(language.vector(t.encode()))[0] != "und"]
    assert docs.columns == columns and cases.key(rows(docs)) == cases.key(want)

    docs = docs.checkpoint() if spark.sparkContext.getCheckpointDir() else docs.cache()
    groups = {}
    for i, t in rows(docs):
        groups.setdefault(cases.low(t), []).append((i is not None, i or 0, t))
    want = [(i if held else None, t) for held, i, t in (max(g, key=lambda x: x[:2]) for g in groups.values())]
    docs = stages["exact_dedup"](spark, docs, sf)
    assert docs.columns == columns and cases.key(i for i, _ in rows(docs)) == cases.key(i for i, _ in want)
    assert {cases.low(t) for _, t in rows(docs)} == {cases.low(t) for _, t in want}

    before = rows(docs)
    named = components([(i, fingerprint(t)) for i, t in before])
    docs = stages["simhash_near_dedup"](spark, docs, sf)
    want = [(i, t) for (i, t), c in zip(before, named) if i == c]
    assert docs.columns == columns and cases.key(rows(docs)) == cases.key(want) and len(want) < len(before)

    before = rows(docs)
    gone = {i for i, _ in leaks(before, list(enumerate(items)))}
    docs = stages["decontamination"](spark, docs, sf)
    assert docs.columns == columns and gone and cases.key(rows(docs)) == cases.key((i, t) for i, t in before if i not in gone)

    pieces = stages["packing"](spark, docs, sf).collect()
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    whole = {}
    for p in pieces:
        whole.setdefault(p["doc_id"], {})[p["start"]] = bytes(p["ids"])
    assert {k: b"".join(v[s] for s in sorted(v)) for k, v in whole.items()} == {i: np.array([*t.encode(x, add_special_tokens=False).ids, 2], dtype="<u4").tobytes() for i, x in rows(docs)}

    run = corpus_pipeline.run(spark, sf)
    assert cases.key((r["doc_id"], r["start"], bytes(r["ids"])) for r in run.collect()) == cases.key((p["doc_id"], p["start"], bytes(p["ids"])) for p in pieces)


def test_empty(spark, tmp_path):
    sf = str(tmp_path)
    cases.docs(spark, []).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert corpus_pipeline.run(spark, sf).collect() == []

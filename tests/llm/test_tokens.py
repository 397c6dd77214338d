import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftlens.llm import common, packing, token_file, tokens
from driftlens.llm.tokens import encoder

from . import cases


def ids(name, text, end):
    return np.array([*Tokenizer.from_file(P.path(name)).encode(text, add_special_tokens=False).ids, end], dtype="<u4")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@settings(max_examples=150, deadline=None)
@given(text=st.text(alphabet=st.sampled_from("ab Z9.,'!?\n\t é ñß-_́字<|>\0"), max_size=40))
def test_cached_encoding_is_exact(name, text):
    assert np.frombuffer(encoder(P.path(name)).ids([text])[0], dtype="<u4").tolist() == encoder(P.path(name)).tokenizer.encode(text, add_special_tokens=False).ids


#: Signs, marks that join what is before them, letters whose lower case is longer or depends on others, odd spaces.
ODD = [*"abcXYZ ,.;:!?-'\"*#%&$`_~()[]<>|@/\\019½²①ⅧßéİıſﬁﬃΣσςЖ中ア😀ªº×÷ŉǰẞǅ\n\n  ", "\u0301", "\u0308", "\u0307", "\u0345", "\u00ad", "\u200b", "\u200d", "\ufeff", "\u00a0", "\u3000", "\u2028", "\u180e", "\x85", "\x1c", "\x01", "\0", "\t", "'s", "I'M", "<|endoftext|>", "<|startoftext|>"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_many_odd_texts_are_exact(name):
    rng = random.Random(5)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(1, 40))) for _ in range(10_000)]
    texts += [f"{chr(c)} a{chr(c)}, {chr(c)}b {chr(c).upper()}x." for c in range(0x250)] + [",Z İ,", "long" * 400 + ", end", "a" * 70, "", " ", "\n"]
    e = encoder(P.path(name))
    assert e.plain
    assert e.ids(texts) == [np.array(x.ids, dtype="<u4").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_forgetting_changes_nothing(monkeypatch):
    e = tokens.Encoder(P.path("word_bpe_49k.json"))
    texts = [t for _, t in cases.pairs()]
    once = e.ids(texts)
    monkeypatch.setattr(tokens, "CACHE_WORDS", 5)
    assert [e.ids([t])[0] for t in texts] == once


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50256), st.integers(0, 2**64 - 1), st.just(0)), max_size=700), st.integers(0, 400))
def test_simple8b_round_trip(values, zeros):
    v = np.array(values + [0] * zeros + values[:5], dtype=np.uint64)
    words, offsets = token_file.encode(v)
    assert (token_file.decode(words, offsets, len(v)) == v).all()
    if len(v) > 256:  # a block alone
        a, b = int(offsets[1]), int(offsets[2]) if len(offsets) > 2 else len(words)
        assert (token_file.decode(words[a:b], np.array([0], dtype="<u4"), min(256, len(v) - 256)) == v[256:512]).all()


def test_file_against_the_library(spark):
    path = common.new_path(spark, "t")
    token_file.write_tokens(cases.docs(spark), path, P.path("byte_bpe_50k.json"))
    got = token_file.read_tokens(spark, path).orderBy("start").collect()
    want = sorted((i is not None, i or 0, t) for i, t in cases.pairs())
    assert [r["doc_id"] for r in got] == [i if held else None for held, i, _ in want]
    assert sum(r["n_tokens"] for r in got) == got[-1]["start"] + got[-1]["n_tokens"]
    by_id = {}
    for held, i, t in want:
        by_id.setdefault(i if held else None, []).append(ids("byte_bpe_50k.json", t, 0).tobytes())
    start = 0
    for r in got:
        assert r["start"] == start and bytes(r["ids"]) in by_id[r["doc_id"]]
        by_id[r["doc_id"]].remove(bytes(r["ids"]))
        start += r["n_tokens"]


def test_packing(spark):
    got = packing.pack(cases.docs(spark), P.path("word_bpe_49k.json")).withColumn("crc", F.crc32("ids")).collect()
    assert len({r["sequence_id"] for r in got}) == len(got)
    whole = {}
    for r in got:
        assert r["length"] == 1 << r["bucket"] and r["length"] <= 4096 and r["offset"] == 0 and len(r["ids"]) == 4 * r["length"] and r["crc"] == zlib.crc32(bytes(r["ids"]))
        whole.setdefault((r["doc_id"], r["doc_tokens"]), {})[r["start"]] = bytes(r["ids"])
    want = {(i, len(x := ids("word_bpe_49k.json", t, 2))): x.tobytes() for i, t in cases.pairs()}
    assert {k: b"".join(v[s] for s in sorted(v)) for k, v in whole.items()} == want


def test_empty(spark):
    path = common.new_path(spark, "t")
    token_file.write_tokens(cases.docs(spark, []), path, P.path("byte_bpe_50k.json"))
    assert token_file.read_tokens(spark, path).collect() == [] and packing.pack(cases.docs(spark, []), P.path("word_bpe_49k.json")).collect() == []


def test_cuts():
    assert packing.cuts(4096 * 2 + 5, 4096) == [4096, 4096, 4, 1] and packing.cuts(1, 4096) == [1]


def test_rows_of_one_id_are_spread_over_the_shards(spark, tmp_path):
    rows = [(7, f"text {i} of one id") for i in range(3000)] + [(7, "repeated")] * 3000 + [(None, "a"), (1, "b"), (9, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    token_file.write_tokens(df, f"{tmp_path}/t", P.path("byte_bpe_50k.json"))
    shards = spark.read.parquet(f"{tmp_path}/t").groupBy("shard").agg({"n_ids": "sum"}).collect()
    assert len(shards) == 4 and max(r[1] for r in shards) < sum(r[1] for r in shards) / 2
    found = token_file.read_tokens(spark, f"{tmp_path}/t").orderBy("start").collect()
    assert [r["doc_id"] for r in found] == [None, 1] + [7] * 6000 + [9]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(found, found[1:]))

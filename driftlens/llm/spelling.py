"""Spelling variant grouping: words one code point apart, and for each the far commoner word it is a variant of.

Words are counted in bounded dictionaries within tasks before they are shuffled. The bigrams of the distinct words are
ordered by frequency, rarest first (ties by the bigram, then by position), and each word keeps its PREFIX rarest: one
edit spoils two bigrams at most, so two words that differ by one edit share one of these three, at most one position apart.
Since that edit lies on one side of the shared bigram, the words are equal on the other side and through it: a
word's keys are what stands up to the end of each such bigram, and from its start on, each with a length, and where that is
the lesser part also half of the rest. That states bigram and position limit, and leaves few candidates for the exact
comparison. A key that many words share is divided into blocks, so that no task holds it whole.

Defined results: null text has no words, a null doc_id reads as the empty string in the checksum; rows repeated count
each time; of equally common near words the smallest in code-point order is the form; texts and words of any length are
read whole, texts in stretches; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm import common as C

#: Of so many pairs of document and run, one loses a code point.
SPOILED = 199
LEAST_LENGTH, LEAST_COUNT, FACTOR = 6, 5, 5
#: Whole runs that are long enough; shorter ones never match.
RUN, OTHER = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}"), re.compile("[^A-Za-zÀ-ÿ]")
PREFIX = 3
#: Characters read at a time, distinct words held before they are passed on, and words of a key that are compared as one block.
STRETCH, HELD, BLOCK = 1 << 20, 1 << 17, 1024
#: Tells keys for words of different lengths from keys for words of equal ones.
LONGER = 0x9E3779B97F4A7C15


def stretches(text: str) -> Iterator[str]:
    """The text in pieces of about STRETCH characters that don't cut a run."""
    at = 0
    while at < len(text):
        end = OTHER.search(text, at + STRETCH)
        to = end.start() if end else len(text)
        yield text[at:to]
        at = to


def add_words(held: Counter, doc_id: int | None, text: str) -> None:
    """Adds the words of a text, spoiled ones as they then read."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    spoiled: Counter = Counter()
    checked: set[str] = set()
    for piece in stretches(text):
        runs = RUN.findall(piece.encode().lower().decode())  # bytes have lower case for A-Z only
        held.update(runs)
        spoiled.update(run for run in runs if run in spoiled)
        fresh = set(runs) - checked
        checked |= fresh
        for run in fresh:
            if zlib.crc32(run.encode(), start) % SPOILED == 0:
                spoiled[run] = runs.count(run)
    for run, n in spoiled.items():
        at = zlib.crc32(run.encode(), start) % len(run)
        held[run] -= n
        if len(run) > LEAST_LENGTH:
            held[run[:at] + run[at + 1 :]] += n


def _sent_on(found: Counter, names: tuple[str, str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=list(names))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), C.strings_of(batch)):
            add_words(held, doc_id, text)
            if len(held) >= HELD:
                yield _sent_on(held, ("word", "n"))
                held.clear()
    yield _sent_on(held, ("word", "n"))


def count_words(docs: DataFrame) -> DataFrame:
    """word, n: the words that occur LEAST_COUNT times or more."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def bigrams(word: str) -> list[str]:
    return [word[i : i + 2] for i in range(len(word) - 1)]


def _count_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()
    for batch in batches:
        for word in C.strings_of(batch, "word"):
            held.update(bigrams(word))
    yield _sent_on(held, ("bigram", "n"))


def bigram_ranks(words: DataFrame) -> dict[str, int]:
    """Rank of each bigram, rarest first. The alphabet has 90 letters, so there are 8,100 at most."""
    counts = words.select("word").mapInArrow(_count_bigrams, "bigram string, n long").groupBy("bigram").agg(F.sum("n").alias("n")).collect()
    return {r["bigram"]: k for k, r in enumerate(sorted(counts, key=lambda r: (r["n"], r["bigram"])))}


def rarest(word: str, ranks: dict[str, int]) -> list[int]:
    """Positions of the PREFIX rarest bigrams."""
    ranked = sorted([(ranks[b], i) for i, b in enumerate(bigrams(word))])
    return [i for _, i in ranked[:PREFIX]]


def keys(word: str, at: list[int], shorter: int) -> set[int]:
    """Keys of a word by its rare bigrams at the given positions, to meet another one; shorter: the length of the shorter
    of the two. The edit lies behind the bigram or before it. The other side, with the bigram, is equal; where that is less
    than the rest, one half of the rest is equal too."""
    found = []
    for p in at:
        for side, equal, rest in (("<", word[: p + 2], word[p + 2 :]), (">", word[p:], word[:p])):
            r = shorter - len(equal)  # what is left of the shorter word
            if r < 0:  # no room for the edit
                continue
            name = f"{side}{shorter} {equal}"
            if len(equal) >= r:
                found.append(name)
            else:
                found += [f"{name} <{rest[: r // 2]}", f"{name} >{rest[len(rest) - r + r // 2 :]}"]
    return {xxhash.xxh64_intdigest(k) for k in found}


def roles(word: str, ranks: dict[str, int]) -> tuple[set[int], set[int], set[int]]:
    """Keys to meet words of equal length, of one more and of one less."""
    at = rarest(word, ranks)
    same = keys(word, at, len(word))
    return same, {k ^ LONGER for k in same}, {k ^ LONGER for k in keys(word, at, len(word) - 1)}


def with_keys(words: DataFrame) -> DataFrame:
    """word, n, asks, answers: a word of equal length, or one longer, answers under a key that the other asks for."""
    sent = words.sparkSession.sparkContext.broadcast(bigram_ranks(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(same, more, less) for same, more, less in (roles(w, sent.value) for w in C.strings_of(batch, "word"))]
            asks, answers = (pa.array([[k - (1 << 63) for k in f[0] | f[role]] for f in found], pa.list_(pa.int64())) for role in (1, 2))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), asks, answers], names=["word", "n", "asks", "answers"])

    return words.mapInArrow(run, "word string, n long, asks array<long>, answers array<long>")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, a_n, b, b_n: each pair of words that are one inserted, deleted or replaced code point apart, once."""
    keyed = C.saved(with_keys(words), "keyed")
    index = keyed.select(F.explode("answers").alias("key"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    full = index.groupBy("key").count().filter(F.col("count") > BLOCK)
    full = C.saved(full.select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "full")  # sent only if its files are small
    index = index.join(full, "key", "left").select("key", F.coalesce(F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"), F.lit(0)).alias("block"), "b", "b_n")
    asked = keyed.select(F.explode("asks").alias("key"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    asked = asked.join(full, "key", "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1))).drop("blocks")
    once = (F.length("a") < F.length("b")) | ((F.length("a") == F.length("b")) & (F.col("a") < F.col("b")))
    found = asked.join(index, ["key", "block"]).filter(once).filter(F.levenshtein("a", "b", 1) == 1)
    return found.select("a", "a_n", "b", "b_n").distinct()


def follow(forms: DataFrame) -> DataFrame:
    """word, root, from word, form: forms are followed to the last. A form is FACTOR times as common as its word, so chains
    are short, and each round doubles the steps taken."""
    roots = C.saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = C.saved(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = joined.select("word", "root")
        if joined.filter("moved").isEmpty():
            return roots


def variants(docs: DataFrame) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    words = C.saved(count_words(docs), "words")
    pairs = C.saved(near_pairs(words), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    near_n = -F.col("best.minus")
    is_form = near_n >= FACTOR * F.col("n")
    found = words.join(best, "word", "left").select("word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, near_n).alias("form_n"))
    found = C.saved(found, "forms")
    roots = follow(found.filter("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

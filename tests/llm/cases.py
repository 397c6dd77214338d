"""Documents that hold the awkward cases, and plain Python versions of what the operators share."""

import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

WORDS = "the of Thing anrent inand était über niño größe ça mañana and License, apache licence version 2 MIT under 4.0 cc by nc x".split()
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Other columns, some of them with names that operators use inside.
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("row", T.StringType()), T.StructField("fp", T.LongType()), T.StructField("bucket", T.StringType()), T.StructField("norm", T.StringType())])


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows():
    rng = random.Random(3)
    long = prose(rng, 9000)
    passage = prose(rng, 120)
    texts = [None, "", " \n\t ", "A", "a", "...", "é", "É", "one two", "one two three", "One Two Three", "x" * 450, "ab " * 300, long, long.upper(), long + " end", "a\x00b", "<|endoftext|> word", "two  spaces\n\nand lines. \n x", "Licensed under the MIT License. Apache License, Version 2.0; CC BY-NC 4.0"]
    texts += [prose(rng, rng.randint(3, 200)) for _ in range(25)]
    texts += [prose(rng, 40) + " " + passage + " " + prose(rng, 30) for _ in range(4)]
    texts += [passage, passage, passage.title(), passage[:400] + "!" + passage[401:]]
    texts += [texts[22], texts[22], texts[23].lower()]
    found = [(i * 7 % 101, t, ("en", "fr", None)[i % 3], "s", 1, "r", 5, "b", "n") for i, t in enumerate(texts)]
    found += [found[25], found[25], (None, "nobody's text", "en", None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return found


def docs(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)


def pairs():
    return [(r[0], r[1] or "") for r in rows()]


def low(text):
    return text.translate(LOWER)


def key(values):
    return sorted(values, key=repr)


def hex_digest(column):
    return F.lower(F.hex(column))

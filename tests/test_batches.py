"""Texts reach Python in small batches, and what is read off them there is what the Column functions say."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlens.functions import chars, links, rails, similarity, versions
from driftlens.plans import edits


@F.pandas_udf(T.LongType())
def held(texts: pd.Series) -> pd.Series:
    return pd.Series([int(texts.str.len().sum())] * len(texts))


def test_batches_do_not_grow_with_the_table(spark, tmp_path):
    spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    most = edits.versions(spark, str(tmp_path)).repartition(1).select(held("t").alias("n")).agg(F.max("n")).first()[0]
    assert most < 2 * versions.BATCH


def test_the_arrow_pass_says_what_the_columns_say(spark):
    texts = [("", ""), (None, "on telegram"), ("a b c", "a  B\tc"), ("ﬁne paуpal", "fine paypal dm me"), ("x", "x y ​z ÉTÉ"), ("venmo me", "")]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "i int, t string, c string")
    words = lambda c: similarity.tokens(chars.normalize_for_match(c))
    shown = df.select(
        versions.matched(F.col("c")) == chars.normalize_for_match("c"), F.abs(versions.jaccard(F.col("t"), F.col("c"))["tokens"] - similarity.jaccard(F.array_distinct(words("t")), F.array_distinct(words("c")))) < 1e-12,
        F.abs(versions.jaccard(F.col("t"), F.col("c"))["bigrams"] - similarity.jaccard(similarity.shingles(words("t")), similarity.shingles(words("c")))) < 1e-12,
        versions.rails_in(F.col("t"), F.col("c"))["rails_after"] == rails.rails(chars.strip_and_fold("c")), versions.rails_in(F.col("t"), F.col("c"))["rails_before"] == rails.rails(chars.strip_and_fold("t")),
    )
    assert all(all(r) for r in shown.collect())


def test_a_text_is_searched_once_for_what_it_defines(spark):
    text = "[one][A] and [a] [b\nc][]\n[a]: <https://one.example.org/x>.\n [A]: https://two.example.org\n[b c]: https://three.example.org,\nx [d]: https://no.example.org"
    found = spark.createDataFrame([(text,), ("[a] and [b]: nothing",), (None,)], "t string").select(links.reference_links(F.col("t")).alias("r"))
    assert found._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(") <= 2  # definitions and usages
    rows = [[tuple(x) for x in r["r"]] for r in found.collect()]
    one, three = "https://one.example.org/x", "https://three.example.org"
    assert rows[0] == [(one, "one"), (one, "a"), (three, "b\nc"), (one, "a"), (one, "A"), (three, "b c")] and rows[1:] == [[], []]

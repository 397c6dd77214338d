"""The table function against the Column functions, and its places."""

import random

from pyspark.sql import functions as F

from driftlens.functions import links, tables

TEXTS = [
    None, "", "no link", "check https://example.com/page now", "read this (https://a.com/x). https://a.com/x", "`https://a.com` and ```\nhttps://b.com\n``` then ~~~\nhttps://c.com\n~~~ https://d.com",
    "Check the [docs][a] first\n\n[a]: https://evil.ru/payload", "visit www.example.com/page today", "[click me](javascript:alert(1))", "[t](https://a.com/f(b) <ftp://f.org/a> <https://u.org>", "[x]\n[X]: <https://one.org>.\n[x]: https://two.org\n [y][]",
    "http://www.x.com/p?q=1 HTTPS://BIG.org/A Kttps://k.org [ſ](HTTPS://s.org)", "![img](https://i.org/a.png \"title\") [l]( <https://sp.org/x> )", "a https://nb.org/x y　https://id.org [r]: https://ls.org", "[a]\n\n   [a]: https://in.org\n     [b]: https://deep.org [b]",
]


def test_rows_kept_first_equal_the_column_function(spark):
    rng = random.Random(5)
    parts = ["https://a.org/x", "www.b.org", "[t](https://c.org)", "[u][r]", "[r]", "\n[r]: https://d.org\n", "`", "```", "~~~", "<https://e.org>", "(", ")", ".", " ", "\n", "word", "[v](data:x)", "!", "[", "]", " ", "é"]
    texts = TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    tables.register(spark)
    df.createOrReplaceTempView("texts_with_links")
    rows = spark.sql("SELECT i, l.* FROM texts_with_links, LATERAL links(t) l").collect()
    found = {}
    for r in rows:
        text = texts[r["i"]]
        assert 0 <= r["start"] < len(text) and r["form"] in ("markdown", "dangerous", "reference", "autolink", "bare", "www")
        if r["first"]:
            found.setdefault(r["i"], []).append((r["href"], r["text"]))
    want = {r["i"]: [(x["href"], x["text"]) for x in r["refs"]] for r in df.select("i", links.extract_link_refs(F.col("t")).alias("refs")).collect() if r["refs"]}
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()} and len(want) > 200


def test_places_and_order():
    text = "see [the manual][M1] https://b.org [m1]\n\n[m1]: https://one.org/a.\n[M1]: https://two.org"
    found = list(tables.every_link(text))
    assert [(f, h, t) for f, h, t, _ in found][:4] == [("reference", "https://one.org/a", "the manual"), ("reference", "https://one.org/a", "m1"), ("reference", "https://one.org/a", "m1"), ("reference", "https://one.org/a", "M1")]
    assert all(text[at:].startswith(("[", "http")) for *_, at in found) and found[4][3] == text.index("https://b.org")


def test_a_long_text_of_openings_ends_soon():
    import time

    began = time.time()
    list(tables.every_link("[" * 4000 + "](" * 500))
    assert time.time() - began < 2

"""The brand index against the fixed brands' rules and against comparing all with all."""

import random

import duckdb
from pyspark.sql import functions as F

from driftlens.functions import dims, lookalike
from driftlens.operators import brands
from driftlens.plans import catalogue as K

TABLE = "ord int, label string, domain string"


def test_remainders():
    assert brands.remainders("abc", 1) == {"abc", "ab", "ac", "bc"} and brands.remainders("ab", 2) == {"ab", "a", "b", ""}
    rng = random.Random(1)
    for _ in range(3000):  # words within two edits have a remainder in common
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(2, 7))) for _ in range(2))
        d = lookalike.osa(a, b)
        if d <= 2:
            assert brands.remainders(a, d) & brands.remainders(b, d)


def test_equals_the_rules_of_the_fixed_brands(spark):
    names = K.names(spark, "/root/testdata/sf0.001")
    extra = [(x, d) for b, d in dims.BRANDS for x, d in ((b, d), (b, b + ".xyz"), ("my" + b + "0", "x.com"), (b[:2] + b[3:], d), (b + "xy", "y.com"))] + [("", "a.com"), (None, "a.com"), ("paypa1", None)]
    labels = names.select("label", "domain").unionByName(spark.createDataFrame(extra, "label string, domain string"))
    near = labels.distinct().withColumn("near", F.get(lookalike.near_brands(F.array(lookalike.deglyph(F.col("label")))), F.lit(0)))
    want = near.filter("domain IS NOT NULL").withColumn("m", lookalike.find_lookalike(F.col("label"), F.col("domain"), F.col("near"))).filter("m IS NOT NULL")
    want = {(r["label"], r["domain"]): (r["m"]["brand"], r["m"]["kind"], r["m"]["distance"], r["m"]["severity"]) for r in want.collect()}
    found = {(r["label"], r["domain"]): (r["brand"], r["kind"], r["distance"], r["severity"]) for r in brands.match(labels, dims.brands(spark)).collect()}
    assert found.pop(("paypa1", None)) == ("paypal", "homoglyph", 0, "high")
    assert found == want and len(want) > 150 and {w[1] for w in want.values()} == set(brands.KINDS)


def made_up(n, seed):
    rng = random.Random(seed)
    words = set()
    while len(words) < n:
        words.add("".join(rng.choice(["ba", "ko", "mi", "re", "tu", "x", "lo", "za", "ne", "q"]) for _ in range(rng.randint(4, 6))))
    return sorted(words)


def test_a_hundred_thousand_brands(spark):
    names, rng = made_up(100_000, 2), random.Random(3)
    rng.shuffle(names)
    table = [(i, b, f"{b}.com") for i, b in enumerate(names)]

    def changed(w):
        w = list(w)
        for _ in range(rng.randint(1, 2)):
            at, kind = rng.randrange(len(w)), rng.randrange(4)
            if kind == 0:
                w[at] = rng.choice("abkxw")
            elif kind == 1:
                w.insert(at, rng.choice("abkxw"))
            elif kind == 2 and len(w) > 1:
                del w[at]
            else:
                w[at : at + 2] = w[at : at + 2][::-1]
        return "".join(w)

    labels = sorted({changed(rng.choice(names)) for _ in range(120)} | {rng.choice(names) + "login" for _ in range(20)} | {"".join(rng.choice("bcdfgh") for _ in range(9)) for _ in range(20)} | set(rng.sample(names, 20)))
    labels = [x for x in labels if "rn" not in x]  # a pair of letters that is folded
    rows = [(x, f"{x}.com") for x in labels]
    result = brands.match(spark.createDataFrame(rows, "label string, domain string"), spark.createDataFrame(table, TABLE))
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    found = {r["label"]: (r["brand"], r["kind"], r["distance"]) for r in result.collect()}

    con = duckdb.connect()  # its distance is never more than ours, so all that are near come through
    con.execute("CREATE TABLE b AS SELECT unnest(range(100000)) AS ord, unnest(?) AS brand", [names])
    con.execute("CREATE TABLE l AS SELECT unnest(?) AS label", [labels])
    pairs = con.execute("""SELECT label, brand, ord FROM l JOIN b ON label <> brand AND (
        (length(brand) BETWEEN 4 AND length(label) - 1 AND length(label) <= length(brand) + 14 AND contains(label, brand)) OR (length(brand) >= 4 AND abs(length(label) - length(brand)) <= 2 AND damerau_levenshtein(label, brand) <= 2))""").fetchall()
    want = {}
    for label, brand, k in pairs:
        d = lookalike.osa(label, brand)
        inside = len(brand) < len(label) and brand in label
        rule = 1 if inside else 2 if d == 1 else 3 if d == 2 and len(brand) >= 8 else None
        if rule:
            want.setdefault(label, []).append((rule, k, brand, 0 if rule == 1 else d))
    want = {label: (min(v)[2], brands.KINDS[min(v)[0]], min(v)[3]) for label, v in want.items()}
    assert found == want and sum(v[1] == "near-edit" for v in want.values()) > 30


def test_empty_tables(spark):
    labels, table = spark.createDataFrame([("paypa1", "paypa1.com")], "label string, domain string"), dims.brands(spark)
    assert brands.match(labels, table.limit(0)).count() == 0 and brands.match(labels.limit(0), table).count() == 0
    assert brands.match(labels, spark.createDataFrame([(0, None, "x.com"), (1, "", "y.com")], TABLE)).count() == 0

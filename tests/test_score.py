import math

import pytest
from pyspark.sql import functions as F

from driftlens.functions.links import REFS, extract_link_refs
from driftlens.operators.score import band, noisy_or, score_drift

BREAD = "Our neighbour baked nine loaves of rye bread before sunrise and gave every one of them away."
NOTE = "seven tram stops lie between our harbour and that museum"
# approved, current, approved links, minutes, late hours, whether links are read, the derived score
VECTORS = {
    "domain swap": ("Chart of tides: https://goodsite.com/tides", "Chart of tides: https://badsite.ru/tides", ["https://goodsite.com/tides"], 5, 0, True, None),
    "cloak": ("all in order", "settle it at [paypal.com](https://evil-bait.ru/login)", [], 5, 0, True, 0.9842), "leet": ("ok", "open https://paypa1.com/login", [], 5, 0, True, 0.9895),
    "combosquat": ("see", "https://paypal-secure.com/verify", [], 5, 0, True, 0.9939), "javascript": ("ok", "[click](javascript:alert(1))", [], 5, 0, True, 0.9916), "bidi": ("weir mill", "weir‮mill by dam", [], 5, 0, False, 0.9370),
    "zero width": ("river bank", "riv​er bank", [], 5, 0, False, 0.4), "decimal ip": ("ok", "open http://3627734734/login", [], 5, 0, True, 0.9424), "rails": ("good to know!", "good! dm me, telegram t.me/quickdeals", [], 5, 0, True, 0.8455),
    "identical": (BREAD, BREAD, [], 5, 0, False, 0.0), "typo": (BREAD.replace("neighbour", "neighbor"), BREAD, [], 5, 0, False, 0.0), "timing": (BREAD, BREAD, [], 6000, 1, False, 0.2),
    "rewrite": ("Tomatoes ripen late this year.", "Nobody expected twelve violinists, three drummers and one harpist to rehearse inside an empty swimming pool.", [], 5, 0, False, 0.58),
    "dilution": (NOTE, f"{NOTE} whoever likes bargains opens https://bit.ly/sketchy-shop with pleasure", [], 5, 0, True, 0.8267),
    "same domain": ("The survey of the eastern bridges stands at https://goodsite.com/a with maps, dates and builders.", "The survey of the eastern bridges stands at https://goodsite.com/a with maps, dates and builders. Newer maps: https://goodsite.com/b too.", ["https://goodsite.com/a"], 5, 0, True, 0.6),
    "defanged": ("all in order", "[paypal[.]com](https://evil-bait.ru)", [], 5, 0, True, None), "spoof": ("my page", "my page https://pаypal.com/login", [], 5, 0, True, None),
    "nulls": (None, None, None, 5, 0, False, 0.0), "two dangers": ("a", "[x](javascript:b) [y](data:c)", [], 5, 0, True, None),
}


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(k, a, b, links, float(m), float(h), use) for k, (a, b, links, m, h, use, _) in VECTORS.items()]
    df = spark.createDataFrame(rows, "name string, approved_body string, current_body string, approved_links array<string>, minutes_since_approval double, late_edit_hours double, use boolean")
    df = df.withColumn("current_refs", F.when(F.col("use"), extract_link_refs(F.col("current_body"))).otherwise(F.array()).cast(REFS))
    return {r["name"]: r for r in score_drift(df).collect()}


@pytest.mark.parametrize("name", [k for k, v in VECTORS.items() if v[-1] is not None])
def test_derived_scores(scored, name):
    assert scored[name]["score"] == pytest.approx(VECTORS[name][-1], abs=6e-5)


def test_bands_and_signals(scored):
    said = {k: " ".join(r["signals"]) for k, r in scored.items()}
    assert scored["domain swap"]["band"] in ("medium", "high") and scored["spoof"]["band"] == "high" and scored["defanged"]["score"] >= 0.85
    assert "cloaked" in said["cloak"] and "look-alike" in said["spoof"] and "dangerous" in said["javascript"] and "bidi" in said["bidi"] and "solicitation" in said["rails"]
    assert scored["same domain"]["added_domains"] == [] and scored["identical"]["signals"] == [] and scored["identical"]["band"] == "none"
    assert said["timing"] == "edited ~100h after approval" and [s for s in scored["two dangers"]["signals"] if "dangerous" in s] == ["dangerous URL scheme used: javascript:", "dangerous URL scheme used: data:"]
    assert scored["two dangers"]["link"] == pytest.approx(1 - 0.4 * 0.05**2)
    assert scored["dilution"]["signals"][:3] == ["new link added after approval: https://bit.ly/sketchy-shop", "new destination domain not in approved version: bit.ly", "risky new link — URL shortener (bit.ly) hides the destination"]
    assert scored["leet"]["signals"][2] == "brand look-alike: domain 'paypa1' is a visual look-alike of 'paypal' (paypal.com)"
    assert all(0 <= r["score"] <= 1 for r in scored.values())


def test_columns_of_the_caller_stay(spark):
    row = ("a", "a http://b.org/x", ["q"], 5.0, 0.0, "mine", True, {"x": 1}, 7)
    df = spark.createDataFrame([row], "approved_body string, current_body string, approved_links array<string>, minutes_since_approval double, late_edit_hours double, late string, cloaked boolean, change map<string,int>, `a.b` int")
    df = df.withColumn("current_refs", extract_link_refs(F.col("current_body"))).withColumn("texts", F.lit(1)).withColumn("edit", F.lit(2)).withColumn("score", F.lit("old")).withColumn("_hrefs", F.lit(3))
    r = score_drift(df).first()
    assert (r["late"], r["cloaked"], r["change"], r["a.b"], r["texts"], r["edit"], r["_hrefs"]) == ("mine", True, {"x": 1}, 7, 1, 2, 3) and r["score"] > 0.7


def test_noisy_or_and_band(spark):
    df = spark.createDataFrame([(0.5, 0.5), (1.5, 0.0), (-1.0, 0.3), (0.85, 0.0), (0.55, 0.0), (0.3, 0.0), (0.29, 0.0)], "a double, b double")
    got = df.select(noisy_or(F.col("a"), F.col("b")).alias("x"), band(F.col("a")).alias("band")).collect()
    assert [round(r["x"], 9) for r in got[:3]] == [0.75, 1.0, 0.3]
    assert [r["band"] for r in got[3:]] == ["high", "medium", "low", "none"] and not math.isnan(got[0]["x"])

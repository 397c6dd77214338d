"""Domains that look like a tracked brand's."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftlens.functions import dims
from driftlens.functions.binding import bind
from driftlens.functions.chars import fold_confusables


def deglyph(label: Column) -> Column:
    """Lower case, confusables folded, look-alike pairs and digits as letters."""
    s = fold_confusables(F.lower(label))
    for pair, letter in dims.DIGRAPHS:
        s = F.replace(s, F.lit(pair), F.lit(letter))
    return F.translate(s, "".join(dims.LEET), "".join(dims.LEET.values()))


def osa(a: str, b: str) -> int:
    """Edit distance in which swapping neighbours is one edit and no part is edited twice."""
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        two, one = one, row
    return one[-1]


@F.pandas_udf(T.IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else osa(x, y) for x, y in zip(a, b)], dtype="Int32")


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StructType([T.StructField("ord", T.IntegerType()), T.StructField("distance", T.IntegerType())]))))
def near_brands(skeletons: pd.Series) -> pd.Series:
    """For each skeleton of an array: brands of four letters or more within two edits, in order."""

    def near(s: str | None) -> list[dict]:
        found = [(k, osa(s, label)) for k, (label, _) in enumerate(dims.BRANDS) if len(label) >= 4 and abs(len(label) - len(s)) <= 2] if s else []
        return [{"ord": k, "distance": d} for k, d in found if 1 <= d <= 2]

    return skeletons.map(lambda a: [near(s) for s in a] if a is not None else [])


def find_lookalike(label: Column, domain: Column, near: Column, strict: bool = False) -> Column:
    """Struct of brand, kind, distance, severity, reason, or null. near: near_brands of the label's skeleton.

    A brand's skeleton met exactly comes first, then the first brand that stands inside, then the first one edit
    away, then the first two edits away from a brand of eight letters or more. A brand's own domain is exempt from
    that brand; strict: from all of them.
    """
    exempt = domain.isin([d for _, d in dims.BRANDS]) if strict else F.lit(False)
    given = F.struct(label.alias("label"), domain.alias("domain"), near.alias("near"), deglyph(label).alias("skeleton"))
    return F.when((label != "") & ~exempt, bind(bind(given, _candidates), _best))


def _candidates(g: Column) -> Column:
    brand, skeleton, domain, near = dims.brand_array(), g["skeleton"], g["domain"], g["near"]
    size = F.length(skeleton)
    others = F.filter(brand, lambda b: (b["domain"] != domain) & (F.length(b["label"]) >= 4))
    same = F.get(F.filter(brand, lambda b: (b["label"] == skeleton) & (b["domain"] != domain)), F.lit(0))
    inside = F.get(F.filter(others, lambda b: F.contains(skeleton, b["label"]) & (size > F.length(b["label"])) & (size <= F.length(b["label"]) + 14)), F.lit(0))
    at = lambda n: F.filter(near, lambda x: (x["distance"] == n) & (F.get(brand, x["ord"])["domain"] != domain) & (F.length(F.get(brand, x["ord"])["label"]) >= (4 if n == 1 else 8)))
    one, two = F.get(brand, F.get(at(1), F.lit(0))["ord"]), F.get(brand, F.get(at(2), F.lit(0))["ord"])
    return F.struct(g["label"].alias("label"), same.alias("same"), inside.alias("inside"), one.alias("one"), two.alias("two"))


def _best(g: Column) -> Column:
    label, same, inside, one, two = (g[k] for k in ("label", "same", "inside", "one", "two"))

    def match(b: Column, kind: str, distance: int, severity: str, reason: Column) -> Column:
        return F.struct(b["label"].alias("brand"), F.lit(kind).alias("kind"), F.lit(distance).alias("distance"), F.lit(severity).alias("severity"), reason.alias("reason"))

    quoted = lambda x: F.concat(F.lit("'"), x, F.lit("'"))
    return (
        F.when(same.isNotNull(), match(same, "homoglyph", 0, "high", F.concat(F.lit("domain "), quoted(label), F.lit(" is a visual look-alike of "), quoted(same["label"]), F.lit(" ("), same["domain"], F.lit(")"))))
        .when(inside.isNotNull(), match(inside, "combosquat", 0, "high", F.concat(F.lit("combosquat: "), quoted(label), F.lit(" wraps the brand "), quoted(inside["label"]))))
        .when(one.isNotNull(), match(one, "near-edit", 1, "high", F.concat(F.lit("domain "), quoted(label), F.lit(" is 1 edit away from brand "), quoted(one["label"]))))
        .when(two.isNotNull(), match(two, "near-edit", 2, "medium", F.concat(F.lit("domain "), quoted(label), F.lit(" is 2 edits away from brand "), quoted(two["label"]))))
    )

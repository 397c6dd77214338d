"""Token and shingle similarity of two versions, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftlens.functions.binding import bind


def tokens(matched: Column) -> Column:
    """Of text in match form."""
    return F.filter(F.split(matched, " "), lambda t: t != "")


def token_set(matched: Column) -> Column:
    return F.array_distinct(tokens(matched))


def shingles(words: Column, k: int = 2) -> Column:
    """Distinct runs of k words; none of no words, all of them as one if they are fewer than k."""

    def runs(w: Column) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " "))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(found))

    return bind(words, runs)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    one_empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when(one_empty, F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def missing_fraction(a: Column, b: Column) -> Column:
    """The part of b that isn't in a; 0 if b is empty."""
    return F.when(F.size(b) == 0, F.lit(0.0)).otherwise(1 - F.size(F.array_intersect(a, b)) / F.size(b))


def change_profile(a: Column, b: Column) -> Column:
    """Struct of similarity (mean of token and bigram Jaccard), added_fraction, removed_fraction of two word arrays."""

    def sets(g: Column) -> Column:
        return F.struct(F.array_distinct(g["a"]).alias("x"), F.array_distinct(g["b"]).alias("y"), shingles(g["a"]).alias("sx"), shingles(g["b"]).alias("sy"))

    def profile(g: Column) -> Column:
        return F.struct(
            (0.5 * jaccard(g["x"], g["y"]) + 0.5 * jaccard(g["sx"], g["sy"])).alias("similarity"),
            missing_fraction(g["x"], g["y"]).alias("added_fraction"), missing_fraction(g["y"], g["x"]).alias("removed_fraction"),
        )

    return bind(bind(F.struct(a.alias("a"), b.alias("b")), sets), profile)

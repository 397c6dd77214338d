"""Look-alikes of a table of brands of any size.

The same rules as functions.lookalike.find_lookalike, whose brands are fixed and travel with each row; here brands are a
table, and a label meets only those that can match it, by equal keys: its skeleton for exact ones; the four-letter piece that
fewest brands share for brands that stand inside it; and, for one or two edits, what is left after as many deletions, as two
strings so close (swapped neighbours included) have such a remainder in common. Every meeting is checked by its rule.

brands: ord (of any type that has an order), label, domain; of equal skeletons the smallest ord that isn't exempt counts. Labels: label, domain; each
different pair once in the result. Null or empty labels match nothing, and brands without a label are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.functions.lookalike import deglyph, osa_distance

#: Fixed values of the rules: the least length of a brand that is looked for inside a label and one edit away, two edits away, and how much longer a label may be.
LEAST, LEAST_TWO, LONGER = 4, 8, 14
KINDS, SEVERITIES = ["homoglyph", "combosquat", "near-edit", "near-edit"], ["high", "high", "high", "medium"]


def remainders(word: str, most: int) -> set[str]:
    """What is left of a word after up to most deletions."""
    return {"".join(c for i, c in enumerate(word) if i not in gone) for n in range(most + 1) for gone in combinations(range(len(word)), n)}


def _keyed(most_of: dict[int, int]):
    """Adds key, one row for each remainder; by the skeleton's length, how many deletions are tried (none: no row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, word in enumerate(batch.column("skeleton").to_pylist()):
                if most := most_of.get(len(word), 0):
                    own = {xxhash.xxh64_intdigest(r) - (1 << 63) for r in remainders(word, most)}
                    rows += [i] * len(own)
                    found += own
                if len(rows) > 1 << 16 or i == batch.num_rows - 1:
                    part = batch.take(pa.array(rows, pa.int64()))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.int64())], names=[*batch.schema.names, "key"])
                    rows, found = [], []

    return run


def _pieces(word: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word) - LEAST + 1), lambda i: F.substring(word, i, LEAST)))


def match(labels: DataFrame, brands: DataFrame) -> DataFrame:
    """label, domain, brand, brand_domain, kind, distance, severity of the labels that look like a brand, with the best one:
    an equal skeleton, then the first brand inside, one edit away, two edits away."""
    found = labels.select("label", "domain").filter("label <> ''").distinct().withColumn("skeleton", deglyph(F.col("label")))
    known = brands.filter("label <> ''").select("ord", F.col("label").alias("brand"), F.col("domain").alias("brand_domain"), deglyph(F.col("label")).alias("known"))
    size, of = F.length("skeleton"), F.length("known")
    rule = lambda kind, distance: (F.lit(kind).alias("rule"), F.lit(distance).cast("int").alias("distance") if isinstance(distance, int) else distance)
    columns = ("label", "domain", "ord", "brand", "brand_domain")
    foreign = ~F.col("domain").eqNullSafe(F.col("brand_domain"))

    same = found.join(known, F.col("skeleton") == F.col("known")).filter(foreign).select(*columns, *rule(0, 0))

    # a brand inside: met by the piece of it that fewest brands have
    pieces = known.filter(of >= LEAST).select("ord", "brand", "brand_domain", "known", F.explode(_pieces(F.col("known"))).alias("piece"))
    shared = pieces.groupBy("piece").agg(F.count("*").alias("n"))
    rarest = pieces.join(shared, "piece").groupBy("ord", "brand", "brand_domain", "known").agg(F.min(F.struct("n", "piece")).alias("m")).select("ord", "brand", "brand_domain", "known", F.col("m.piece").alias("piece"))
    asked = found.filter(size > LEAST).select("label", "domain", "skeleton", F.explode(_pieces(F.col("skeleton"))).alias("piece"))
    inside = asked.join(rarest, "piece").filter(foreign & (size > of) & (size <= of + LONGER) & F.contains("skeleton", "known")).select(*columns, *rule(1, 0))

    # one or two edits: met by a common remainder. Lengths of brands say which labels can be near one.
    lengths = [r["n"] for r in known.select(of.alias("n")).distinct().collect() if r["n"] >= LEAST]
    edits = {n: 2 if n >= LEAST_TWO else 1 for n in lengths}
    tried: dict[int, int] = {}
    for n, most in edits.items():
        for other in range(max(1, n - most), n + most + 1):
            tried[other] = max(tried.get(other, 0), most)
    index = known.withColumnRenamed("known", "skeleton").mapInArrow(_keyed(edits), f"ord {brands.schema['ord'].dataType.simpleString()}, brand string, brand_domain string, skeleton string, key long").withColumnRenamed("skeleton", "known")
    asked = found.mapInArrow(_keyed(tried), "label string, domain string, skeleton string, key long")
    met = asked.join(index, "key").filter(foreign & (F.abs(size - of) <= 2) & (F.col("skeleton") != F.col("known"))).drop("key").distinct()
    met = met.withColumn("distance", osa_distance("skeleton", "known"))
    near = met.filter((F.col("distance") == 1) | ((F.col("distance") == 2) & (of >= LEAST_TWO))).select(*columns, *rule(0, F.col("distance")))
    near = near.withColumn("rule", F.col("distance") + 1)

    every = same.unionByName(inside).unionByName(near)
    best = every.groupBy("label", "domain").agg(F.min(F.struct("rule", "ord", "brand", "brand_domain", "distance")).alias("b"))
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("b.rule") + 1)
    return best.select("label", "domain", "b.brand", "b.brand_domain", pick(KINDS).alias("kind"), "b.distance", pick(SEVERITIES).alias("severity"))

"""Corpus pipeline: each stage takes (spark, docs, sf_dir) and its result is written and reread as the next one's docs.

Rows without a known language go, then copies (the largest doc_id of equal texts stays), then near copies (the
smallest doc_id of a group stays), then documents that hold a benchmark item; the rest is packed. Null text has no
language and goes with the first stage. Rows that repeat a document whole are copies; where different texts share a
doc_id, near copies are decided by doc_id: such rows stay or go together. Leaks are decided row by row.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftlens.llm import common, decontaminate, exact_dedup, language, packing, simhash


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trained on the labelled documents of docs; what is und goes. Rows are filtered where they are."""
    return language.keep_known(docs, language.train(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(docs)
    own = common.fresh(docs, "_own")
    kept = found.filter("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"))
    marked = docs.withColumn(own, F.sha2(F.translate(F.coalesce("text", F.lit("")), common.UPPER, common.LOWER), 256))
    left = marked.join(kept, marked["doc_id"].eqNullSafe(kept["id"]) & (marked[own] == kept["sha"]), "left_semi")
    if not found.filter("NOT kept AND doc_id <=> keep_id").isEmpty():  # a row that repeats the one that stays
        n = common.fresh(left, "_n")
        left = left.withColumn(n, F.row_number().over(W.partitionBy("doc_id", own).orderBy("text"))).filter(F.col(n) == 1)
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    first = simhash.near_dedup(docs).filter("doc_id <=> component_id").select(F.col("doc_id").alias("id")).distinct()
    return docs.join(first, docs["doc_id"].eqNullSafe(first["id"]), "left_semi")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", drop_unknown_language), ("exact_dedup", drop_exact_copies), ("simhash_near_dedup", drop_near_copies), ("decontamination", drop_leaks), ("packing", pack)]

#: Language models, SimHash and tokenization can't be written in SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

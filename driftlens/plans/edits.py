"""Edited versions of every document, by one SQL expression that both engines read, and the tables made of it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.functions.links import REFS, extract_link_refs
from driftlens.functions.versions import small_batches

#: What was done to the text t of a document, by its id.
EDIT = """CASE doc_id % 12
    WHEN 1 THEN t || ' see https://bit.ly/sketchy-shop now'
    WHEN 2 THEN t || ' visit https://shop.fresh-example.net/deal?id=1.'
    WHEN 3 THEN t || ' [paypal.com](https://evil.ru/login)'
    WHEN 4 THEN t || ' [click](javascript:run)'
    WHEN 5 THEN t || ' ‮hidden'
    WHEN 6 THEN 'pay​pal ' || t
    WHEN 7 THEN t || ' https://pаypal.com/x'
    WHEN 8 THEN t || ' find us on telegram or dm me'
    WHEN 9 THEN t || ' http://www.paypal-secure.com/login'
    WHEN 10 THEN substr(t, 1, CAST(floor(length(t) / 2.0) AS INT))
    WHEN 11 THEN t || repeat(' filler words that were not there', 40)
    ELSE t END"""
NOW = dt.datetime(2024, 1, 31)


def spread(df: DataFrame) -> DataFrame:
    """A table that is read in fewer parts than there are cores (a small one), dealt to all of them. Larger ones stay
    where they are: work on single rows needs no shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, t (approved), c (current)."""
    small_batches(spark)
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "coalesce(text, '') AS t"))
    return docs.selectExpr("doc_id", "t", f"{EDIT} AS c")


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions as the scorer takes them: nothing was linked when the text was approved, ten minutes before."""
    return versions(spark, sf_dir).select(
        "doc_id", F.col("t").alias("approved_body"), F.col("c").alias("current_body"), F.array().cast("array<string>").alias("approved_links"),
        extract_link_refs(F.col("c")).cast(REFS).alias("current_refs"), F.col("doc_id").cast("double").alias("minutes_since_approval"), F.lit(2.0).alias("late_edit_hours"),
    )


VERSIONS_SQL = f"e AS (SELECT doc_id, t, {EDIT} AS c FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"

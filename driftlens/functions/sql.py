"""The functions that Spark has no built-in for, under names for Spark SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from driftlens.functions import chars, lookalike, urls, versions

#: Name in SQL: function over columns.
FUNCTIONS = {"nfkc": chars.nfkc, "nfkd": chars.nfkd, "osa_distance": lookalike.osa_distance, "parse_urls": urls.parse_urls, "decode_hosts": urls.decode_hosts, "compare_versions": versions._compared}


def register(spark: SparkSession) -> list[str]:
    """Registers them for the session; their names."""
    for name, f in FUNCTIONS.items():
        spark.udf.register(name, f)
    return list(FUNCTIONS)

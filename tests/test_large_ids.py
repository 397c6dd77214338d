"""Queries against their SQL on rows whose ids are as large as in tables of several GB."""

import duckdb

import __spark_entry__
from driftlens.functions import urls


def test_url_tricks_on_pages_beyond_two_bytes(spark, tmp_path):
    ids = [8, 24, 65512, 65544, 65560, 65592, 131096, 799992, 800024]
    spark.createDataFrame([(i, f"https://www.site{i}.example.org/a/{i}?q=1", "") for i in ids], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = __spark_entry__.queries()["url_tricks"](spark, str(tmp_path)).orderBy("page_id").collect()
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert [tuple(r) for r in found] == db.sql(f"SELECT * FROM ({__spark_entry__.oracle_sql()['url_tricks']}) ORDER BY page_id").fetchall()
    assert urls.ipv4("0x18.1.65560") is None and urls.ipv4("0x18.131096") == "24.2.0.24"  # what a last part may hold is as it was

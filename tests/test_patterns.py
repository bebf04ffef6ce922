"""Patterns that both engines read alike, whatever stands beside a word."""

import duckdb
from pyspark.sql import functions as F

from lodestone import catalog

TEXTS = [";var\u4e2d", "\u00dffor}", "\u00dftry :", "yield\x0b\x00", "\x00match\x0b", "class \u00e9:", "let\u0301 x", "import a\rfrom b", "if \x85:", "def f(", "type x\x0b=", "\u2028const a"]


def compare(spark, tmp_path, name):
    path = f"{tmp_path}/pages.parquet"
    spark.createDataFrame(list(enumerate(TEXTS)), "page_id long, html string").withColumn("url", F.lit("u")).write.parquet(path)
    got = catalog.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/*.parquet'")
    columns = ", ".join(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"SELECT {columns} FROM ({catalog.oracle_sql()[name]})").fetchall())


def test_html_complexity(spark, tmp_path):
    compare(spark, tmp_path, "html_complexity")


def test_language_by_content(spark, tmp_path):
    compare(spark, tmp_path, "language_by_content")


def test_chunk_complexity(spark, tmp_path):
    compare(spark, tmp_path, "chunk_complexity")

import duckdb
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "   \n\t ", None, None, None), (4, "One", "en", "a", 3), (5, "one", "en", "b", 3), (6, "one two three", "en", "a", 13), (7, "ONE two three", "en", "a", 13), (8, "12 34 !!", "de", "a", 8),
    (9, "x" * 30_000, "en", "a", 30_000), (10, "word " * 20_000, "fr", "a", 100_000), (11, "Ünïcode ñandú 中文 😀 ▁", "es", "a", 20), (11, "Ünïcode ñandú 中文 😀 ▁", "es", "a", 20), (12, "a b c", "en", "a", 5), (None, "one", "en", "a", 3),
    (13, "the quick brown fox jumps over the lazy dog again and again today", "en", "a", 60), (14, "the quick brown fox jumps over the lazy dog again and again tonight", "en", "a", 60), (15, "<|endoftext|> tail", "en", "a", 18),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty, blank, very short and very long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = spark.createDataFrame(EDGE, SCHEMA)
    return rows.withColumn("score", F.lit("mine")).withColumn("kept", F.lit(0)).withColumn("n", F.lit(1)).withColumn("cls", F.lit("x")).withColumn("row", F.lit(2)).withColumn("h", F.lit(3))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con

"""Test-table access and the derived fixtures the registered queries use.

Every fixture is derived from a given table by Spark, so its size grows
with the table.  The same derivations are written in the SQL oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PROMO_PATTERNS
from ..functions.text import python_regex
from ..session import spread

# Test binding: a word pattern that plays the role of a promotion rule on
# the (non-CJK) test documents.
WORD_PATTERN = r"the\S*ing\S*"
TEST_PATTERNS = PROMO_PATTERNS + (WORD_PATTERN,)
TEST_FEATURES = ("the on", "of the", "ing")
TEST_STOPWORDS = ("the", "on", "of", "and")
TEST_MARKER = "***"
TEST_CHARSET = r"[^\p{L} ]"
PIVOT_TERMS = ("the", "and", "of", "der", "la")
EXCLUDED_NATIONS = ("NATION_3", "NATION_7", "NATION_11")
AMBIGUOUS_NATIONS = ("NATION_1", "NATION_2", "NATION_24")
TEST_SEEDS = ("the", "and", "und", "la", "xyzzy")


# Text tables and their row keys: spread over the cores when a scan is small.
TEXT_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def table(spark: SparkSession, sf_dir: str, name: str, spread_text: bool = True) -> DataFrame:
    """A test table; text tables are spread over the cores unless the caller
    only counts or projects keys (``spread_text=False``)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if spread_text and name in TEXT_KEYS:
        df = spread(df, TEXT_KEYS[name])
    return df


def rated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with a derived star rating 1..5."""
    d = table(spark, sf_dir, "documents")
    return d.withColumn("rating", (F.lit(1) + F.col("doc_id") % 5).cast("double"))


def holed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with missing (null) and empty text mixed in."""
    d = table(spark, sf_dir, "documents")
    text = (F.when(F.col("doc_id") % 7 == 0, F.lit(None).cast("string"))
            .when(F.col("doc_id") % 7 == 1, F.lit("")).otherwise(F.col("text")))
    return d.select("doc_id", text.alias("text"))


def java_pattern(p: str) -> str:
    return python_regex(p)

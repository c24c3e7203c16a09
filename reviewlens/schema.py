"""Schemas of the review tables and the column alias map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType, TimestampType

# Collected reviews, in write order.
RAW_REVIEWS = StructType([
    StructField("ScrapeTime", TimestampType()),
    StructField("RestName", StringType()),
    StructField("PicAttached", StringType()),
    StructField("ReviewerName", StringType()),
    StructField("TotalReviewsByUser", StringType()),
    StructField("ReviewRating", DoubleType()),
    StructField("ReviewDate", StringType()),
    StructField("ReviewDescription", StringType()),
])

# Cleaned reviews (the expansion variant adds a leading RestName).
CLEANED_REVIEWS = StructType([
    StructField("ReviewActualDate", StringType()),
    StructField("Reviewer", StringType()),
    StructField("ReviewRating", DoubleType()),
    StructField("ProcessedReview", StringType()),
    StructField("IsInducing", IntegerType()),
])

# The collector writes ReviewerName; the cleaners read Reviewer.
ALIASES = {"ReviewerName": "Reviewer"}

# Scrape time stamps are stored as text in this format.
SCRAPE_TIME_PATTERN = "yyyy/MM/dd HH:mm:ss"


def apply_aliases(df: DataFrame, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """Rename columns by the alias map (only those present)."""
    present = {a: b for a, b in aliases.items() if a in df.columns and b not in df.columns}
    return df.withColumnsRenamed(present) if present else df


def parse_scrape_time(df: DataFrame, col: str = "ScrapeTime") -> DataFrame:
    """Stored ``yyyy/MM/dd HH:mm:ss`` text -> timestamp (bad text -> null)."""
    if dict(df.dtypes).get(col) == "string":
        return df.withColumn(col, F.try_to_timestamp(F.col(col), F.lit(SCRAPE_TIME_PATTERN)))
    return df

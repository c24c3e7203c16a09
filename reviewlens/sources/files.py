"""File sources and sinks: CSV, tolerant scans, line lists, aligned appends."""

from __future__ import annotations

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import PY_SPACE_CLASS

# CSV options that keep quoted newlines, doubled quotes and edge spaces.
CSV_READ = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"',
            "encoding": "UTF-8", "mode": "FAILFAST"}
CSV_WRITE = {"header": "true", "escape": '"', "quote": '"', "quoteAll": "false",
             "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
             "encoding": "UTF-8"}


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Header CSV with an explicit schema; quoted fields may span lines.

    A leading byte-order mark is dropped by the reader.
    """
    return spark.read.options(**CSV_READ).schema(schema).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).options(**CSV_WRITE).csv(path)


def _path_exists(spark: SparkSession, path: str) -> bool:
    """Existence through the Hadoop file system of the path (HDFS, S3, local).

    Only a path that is not there counts as absent; a denied or broken one raises.
    """
    try:
        sc = spark.sparkContext
    except PySparkException:     # remote sessions have no context: probe with a read
        try:
            spark.read.format("binaryFile").load(path).select("path").limit(1).collect()
            return True
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return False
            raise
    hpath = sc._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(sc._jsc.hadoopConfiguration()).exists(hpath)


def tolerant_scan(spark: SparkSession, path: str, schema: StructType | str,
                  fmt: str = "parquet", **options) -> DataFrame:
    """Read ``path``; a missing path yields an empty table with ``schema``.

    The wanted schema is always applied, so missing columns come back null
    instead of failing the read.
    """
    if not _path_exists(spark, path):
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema).options(**options)
    if fmt == "csv":
        reader = reader.options(**CSV_READ)
    return reader.format(fmt).load(path)


def read_lines(spark: SparkSession, path: str, col: str = "value") -> DataFrame:
    """A line-per-entry list file, stripped (Python whitespace), distinct, no blanks."""
    strip = F.regexp_replace(F.col("value"), f"^[{PY_SPACE_CLASS}]+|[{PY_SPACE_CLASS}]+$", "")
    return (spark.read.text(path).select(strip.alias(col))
            .filter(F.col(col) != "").distinct())


def align_to(df: DataFrame, target: StructType) -> DataFrame:
    """Project ``df`` onto ``target``'s columns: extras dropped, missing null."""
    have = set(df.columns)
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have
                      else F.lit(None).cast(f.dataType).alias(f.name) for f in target.fields])


def aligned_append(spark: SparkSession, df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append ``df`` to the table at ``path``, adopting the stored columns.

    New files are added next to the stored ones (no rewrite of what is
    there); a missing table is created with ``df``'s own columns.
    """
    if _path_exists(spark, path):
        stored = spark.read.format(fmt).load(path).schema
        df = align_to(df, stored)
    df.write.mode("append").format(fmt).save(path)

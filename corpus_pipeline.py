"""Corpus pipeline: five stages over ``documents``, each written before the next reads it.

toxic documents go, one document of each near-duplicate group stays, documents
into which benchmark items leak go, the rest is mixed to source weights, and
the mix is written as bit-packed token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.llm.common import load, small, written
from reviewlens.llm.decontaminate import clean_documents
from reviewlens.llm.jaccard_join import similarity_groups
from reviewlens.llm.mixing import Mix
from reviewlens.llm.token_files import read_token_files, write_token_files
from reviewlens.llm.toxicity import toxicity_scores
from reviewlens.session import scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
END_ID = 2


def _row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


def _only(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, row_key) stands in ``keys``."""
    keys = keys.select(F.col("doc_id").alias("k_id"), F.col("row_key").alias("k_key")).distinct()
    return docs.select(*COLUMNS).join(small(written(keys, "stage-keys")), F.col("doc_id").cast(
        "long").eqNullSafe(F.col("k_id")) & (_row_key() == F.col("k_key")), "left_semi")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose toxicity score reaches 0.5."""
    return _only(docs, toxicity_scores(docs, load(spark, sf_dir, "labels")).filter(
        "predicted = 0"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each near-duplicate component.

    Documents without words link with nothing and all stay; a doc_id that
    repeats as the smallest one of a component keeps its first row.
    """
    groups = written(similarity_groups(docs), "stage-groups")
    alone = groups.filter("n_shingles = 0 or doc_id is null").select("doc_id", "row_key")
    first = groups.filter("n_shingles > 0 and doc_id is not null").groupBy("component_id").agg(
        F.min(F.struct("doc_id", "row_key")).alias("first")).select("first.*")
    kept = _only(docs, alone.union(first))
    return kept.groupBy("doc_id", _row_key().alias("k")).agg(
        *(F.min(c).alias(c) for c in COLUMNS[1:])).select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents into which a benchmark item leaks."""
    return clean_documents(docs, load(spark, sf_dir, "benchmark")).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: a row per document and pass (see ``mixing.Mix.documents``)."""
    return Mix(docs).documents()


def token_binary(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: doc_id, start, n_tokens, ids_crc32."""
    path = write_token_files(docs, scratch_path(spark, "pipeline-tokens"),
                             public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return read_token_files(spark, path)


STAGES = [("toxicity", toxicity), ("ngram_jaccard_join", ngram_jaccard_join),
          ("benchmark_decontamination", benchmark_decontamination),
          ("source_mixing", source_mixing), ("token_binary", token_binary)]

#: learned scores, hashed draws and tokenizers are beyond SQL; see tests/llm/test_pipeline.py
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result is written and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

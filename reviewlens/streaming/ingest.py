"""Incremental ingest of review files with Structured Streaming.

New files under the source folder are picked up once (the file source
remembers them in its checkpoint); each micro-batch is de-duplicated on the
key, anti-joined against the rows already stored and appended.  Rerunning
over the same folder adds nothing, and a restarted query resumes from its
checkpoint after a failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..sources.files import _path_exists, align_to


def _append_new(spark: SparkSession, store: str, key: str):
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.dropDuplicates([key])
        if _path_exists(spark, store):
            stored = spark.read.parquet(store)
            fresh = align_to(fresh, stored.schema).join(stored.select(key), key, "left_anti")
        fresh.write.mode("append").parquet(store)
    return write_batch


def ingest_available(spark: SparkSession, source: str, schema: StructType | str, store: str,
                     checkpoint: str, key: str, fmt: str = "parquet") -> None:
    """Process every file present now (``availableNow``) and stop."""
    stream = spark.readStream.schema(schema).format(fmt).load(source)
    query = (stream.writeStream.foreachBatch(_append_new(spark, store, key))
             .option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def ingest_batch(spark: SparkSession, new: DataFrame, store: str, key: str) -> None:
    """Batch twin of one micro-batch (same rule, no stream)."""
    _append_new(spark, store, key)(new, 0)

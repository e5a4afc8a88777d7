"""Incremental import: every micro-batch is one import against the postings stored so far."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from hiregrain.operators.ingest import import_postings

KEYS = "raw_hash string, content_hash string, source_url string, batch long"


def stored_keys(spark: SparkSession, folder: str, before: int) -> DataFrame:
    """Keys of postings stored by earlier batches; none before the first batch, and an unreadable store is an error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], KEYS.rsplit(",", 1)[0])
    stored = spark.read.parquet(folder)
    return stored.where(F.col("batch") < before).select("raw_hash", "content_hash", "source_url")


def import_batch(batch: DataFrame, batch_id: int, folder: str, extract=None) -> None:
    """Import a micro-batch into ``folder/postings`` and ``folder/quarantine``.

    Output folders are named by batch and replaced when a batch is replayed, and only earlier batches
    count as stored, so a restart stores every posting once.
    """
    spark = batch.sparkSession
    result = import_postings(batch, stored_keys(spark, f"{folder}/postings", batch_id), extract)
    result.postings.write.mode("overwrite").parquet(f"{folder}/postings/batch={batch_id}")
    result.quarantine.write.mode("overwrite").parquet(f"{folder}/quarantine/batch={batch_id}")
    result.summary().write.mode("overwrite").json(f"{folder}/summary/batch={batch_id}")


def stream_import(records: DataFrame, folder: str, checkpoint: str, extract=None) -> DataStreamWriter:
    """A writer that imports a stream of raw records carrying ``record_no``; start it with a trigger."""
    return records.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: import_batch(batch, batch_id, folder, extract)
    )

"""Ingestion of a landing folder as a stream: an extension of the batch stages, with the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def landing(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """JSON-lines records of the files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def ingest(stream: DataFrame, path: str, checkpoint: str, key: str = "chunk_id", by: str = "code", transform: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Writes what has arrived so far, each key once, in partitions by property; then stops.

    The checkpoint remembers files and keys, so a run that is repeated or broken off adds nothing twice.
    """
    once = stream.dropDuplicates([key])

    def write(batch: DataFrame, number: int) -> None:
        out = transform(batch) if transform else batch
        out.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", by).parquet(path)

    once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

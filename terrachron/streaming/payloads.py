"""Payload drops as a stream: deduplicated within a watermark, upserted by key, and counted by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.payloads import SCHEMA, append, latest


def read(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def deduplicated(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One row of each key within the delay; state is dropped behind the watermark."""
    return stream.withWatermark("fetched_at", delay).dropDuplicatesWithinWatermark(["key"])


def arrivals(stream: DataFrame, window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Payloads and bytes by event-time window."""
    kept = stream.withWatermark("fetched_at", delay)
    return kept.groupBy(F.window("fetched_at", window)).agg(F.count("*").alias("n"), F.sum(F.octet_length("body")).alias("bytes"))


def ingest(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch's newest row of every key to a payload table; readers resolve the rest."""

    def put(batch: DataFrame, _: int) -> None:
        append(latest(batch), table)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

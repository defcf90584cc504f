"""Streaming ingestion, an extension: documents that arrive as files, each content stored once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evidentia.operators.ingest import with_hash


def read_documents(spark: SparkSession, path: str, schema: str = "doc_id long, text string, lang string, source string, n_chars long", files_per_trigger: int = 100) -> DataFrame:
    """Parquet files as they appear, with the time of arrival."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream.withColumn("arrived", F.current_timestamp())


def first_contents(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """The first document of each content hash within the delay; state older than that is dropped by the watermark."""
    return with_hash(stream).withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["raw_hash"])


def write_documents(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet, exactly once per checkpoint, until what is there is read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

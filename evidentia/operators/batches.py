"""Arrow batches of bounded size, as a Python worker's memory is bounded by what Spark sends it at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes, about, that Spark sends a Python task at a time.
BATCH_BYTES = 2_000_000
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864"


def bound(spark: SparkSession | None) -> None:
    """Batches of the session are of about BATCH_BYTES, unless it sets another size of its own."""
    if spark is not None and spark.conf.get(_BATCH_SETTING, _BATCH_DEFAULT).rstrip("b") == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def give_back() -> None:
    """Return freed memory to the system; Python workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow in bounded batches."""
    bound(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)

"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import lineage, skew
from evidentia.operators.batches import BATCH_BYTES, map_batches  # noqa: F401

#: Rows up to which a table of a few numbers per row may be broadcast (about 100 MB as a hash table).
BROADCAST_ROWS = 1_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir.

    Where the setting is absent a temporary folder takes its place if driver and executors are one process; else that is an error.
    """
    return lineage.shared_dir(spark)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read of the table, not a recomputation of what led to it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.evidentia_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the folders of materialized tables that nothing will read again: what was made of them must be materialized itself."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.evidentia_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most that many rows, else df as it is (Spark then shuffles both sides).

    df should be cheap to count, as a materialized table is.
    """
    return F.broadcast(df) if df.count() <= rows else df


def is_held_out(doc_id: str = "doc_id"):
    """crc32 of the id's text leaves 2 modulo 4; a row without an id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


#: Bytes of text, about, that a Python task works on at a time.
SLICE_BYTES = 2_000_000


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each part holds about that many bytes of the column, or one row."""
    for b in batches:
        ends = np.frombuffer(b.column(column).buffers()[1], np.int32 if b.column(column).type == pa.string() else np.int64)[b.column(column).offset :][1 : b.num_rows + 1]
        place = (ends - (ends[0] if len(ends) else 0)) // most
        at = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), b.num_rows]
        for i, j in zip(at, at[1:], strict=False):
            if j > i:
                yield b.slice(i, j - i)


def join_by_key(left: DataFrame, right: DataFrame, key: str, copies: str, how: str = "left") -> DataFrame:
    """skew.join_by_key for a materialized left, which is cheap to count."""
    return skew.join_by_key(left, right, key, copies, left.count(), how)

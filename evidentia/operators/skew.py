"""Joins in which one key may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_by_key(left: DataFrame, right: DataFrame, key: str, copies: str, rows: int, how: str = "left") -> DataFrame:
    """left (of so many rows) with right's columns; right has each key once, and in `copies` how many rows of left have it (dropped).

    Keys with more than a hundred-thousandth of left's rows are at most a hundred thousand; they are broadcast, so that rows of
    a frequent key stay where they are. Rows without a key meet nothing and aren't shuffled. Only the others go to a shuffle.
    """
    most = rows // 100_000 + 1_000
    added = [c for c in right.columns if c not in (key, copies)]
    met = left.join(F.broadcast(right.where(F.col(copies) > most).select(key, *added, F.lit(True).alias("evidentia_hot"))), key, "left")
    out = met.where("evidentia_hot").drop("evidentia_hot")
    rest = met.where(F.col("evidentia_hot").isNull() & F.col(key).isNotNull()).drop("evidentia_hot", *added)
    out = out.unionByName(rest.join(right.where(F.col(copies) <= most).drop(copies), key, how))
    return out.unionByName(met.where(F.col(key).isNull()).drop("evidentia_hot")) if how == "left" else out

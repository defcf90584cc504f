"""Running counts and sums along an order within keys, of which one may hold a large share of all rows.

Rows are dealt by ranges of keys and order, so that a frequent key is spread over many ranges. Each range is run through alone; what
comes before a range of the same key is carried over from the ranges' totals, of which a key has as many as it has ranges.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.operators.lineage import written


@dataclass(frozen=True)
class Carried:
    """over: the aggregate of rows, over a window. within: of a range's rows, given their order. again: of ranges, over a window.
    joined: of what is before and what is here, neither null."""

    over: Callable[[], Column]
    within: Callable[[Column], Column]
    again: Callable[[Column], Column]
    joined: Callable[[Column, Column], Column]


COUNT = Carried(lambda: F.count(F.lit(1)), lambda _: F.count(F.lit(1)), F.sum, lambda a, b: a + b)


def total(column: str) -> Carried:
    return Carried(lambda: F.sum(column), lambda _: F.sum(column), F.sum, lambda a, b: a + b)


def xor(column: str) -> Carried:
    return Carried(lambda: F.bit_xor(column), lambda _: F.bit_xor(column), F.bit_xor, lambda a, b: a.bitwiseXOR(b))


def latest(column: str) -> Carried:
    """The last value that isn't null."""
    last = lambda c: F.last(c, ignorenulls=True)
    return Carried(lambda: last(column), lambda order: F.max_by(column, F.when(F.col(column).isNotNull(), order)), last, lambda _, b: b)


def running(rows: DataFrame, keys: list[str], order: list[str], made: dict[str, Carried]) -> DataFrame:
    """rows with each made column: the aggregate of the rows of equal keys up to and with this one, by the order columns, nulls first.

    Rows that are equal in keys and order stand in any order, but in one throughout. A null key is a key like others.
    """
    place, of, by = "evidentia_place", "evidentia_of", "evidentia_range"
    dealt = written(rows.withColumn(place, F.monotonically_increasing_id()).repartitionByRange(*keys, *order, place).withColumn(by, F.spark_partition_id()))
    here = Window.partitionBy(by, *keys).orderBy(*order, place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = dealt.select("*", *[c.over().over(here).alias(name) for name, c in made.items()])
    ranges = dealt.groupBy(by, *keys).agg(*[c.within(F.struct(*order, place)).alias(name) for name, c in made.items()])
    onward = Window.partitionBy(*keys).orderBy(by)
    carried = ranges.select(
        F.col(by).alias(of), *[F.col(k).alias(f"evidentia_key_{k}") for k in keys], F.lag(F.lit(1)).over(onward).alias("evidentia_more"),
        *[c.again(F.col(name)).over(onward.rowsBetween(Window.unboundedPreceding, -1)).alias(f"evidentia_{name}") for name, c in made.items()],
    ).where("evidentia_more is not null")
    same = F.col(by) == F.col(of)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"evidentia_key_{k}"))
    out = local.join(carried, same, "left")

    def whole(name: str, c: Carried) -> Column:
        before, mine = F.col(f"evidentia_{name}"), F.col(name)
        return F.when(before.isNull(), mine).when(mine.isNull(), before).otherwise(c.joined(before, mine)).alias(name)

    return out.select(*rows.columns, *[whole(name, c) for name, c in made.items()])

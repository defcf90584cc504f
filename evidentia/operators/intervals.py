"""Joins of ranges that overlap, without comparing all with all: a binned interval join.

Two ranges overlap if one begins within the other. So there are two joins of points with ranges. A range of coarse coordinates is
cut into cells, the largest aligned blocks of a power of two that fill it, of which there are at most two of each size; a point lies
in one cell of each size. Points and ranges meet in equal cells, each pair in one at most, and an exact test follows. Cells with many
points are dealt over parts, to which their ranges are copied.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions import location
from evidentia.operators.lineage import written
from evidentia.operators.skew import join_by_key

#: Points of a cell that one task meets with the cell's ranges.
PART = 50_000
#: Cells with more than PART points: at most rows / PART of each size, broadcast as long as they are so many.
_HOT_CELLS = 1_000_000


def cells(start: Column, end: Column) -> Column:
    """Array of structs (size, cell): the aligned blocks of 2**size that fill start to end, both included and neither negative; empty for end < start."""
    most = F.greatest(F.lit(0), F.ceil(F.log2((end - start + 2).cast("double"))).cast("int"))
    block = lambda ok, k, cell: F.when(ok, F.struct(k.alias("size"), cell.alias("cell")))

    def of_size(k: Column) -> Column:
        side = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        low, high = F.floor((start + side - 1) / side), F.floor((end + 1) / side)
        return F.array(block((low % 2 == 1) & (low < high), k, low), block((high % 2 == 1) & (low < high), k, high - 1))

    return F.when(end >= start, F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), most), of_size)))).otherwise(F.array())


def points_in_ranges(points: DataFrame, ranges: DataFrame, keys: list[str], exact: Column, part: int = PART) -> DataFrame:
    """Rows of points (keys, at) beside those of ranges (keys, from, to) of equal keys with from <= at <= to, for which exact holds.

    at, from and to are whole numbers from 0 on; columns besides the keys must differ in name. Rows without a key or number meet nothing.
    """
    span = ranges.where(F.col("to") >= F.col("from"))
    longest = span.agg(F.max(F.col("to") - F.col("from"))).first()[0]
    if longest is None:
        return points.drop("at").join(span.drop("from", "to").where("false"), keys)
    sizes = math.ceil(math.log2(longest + 2)) + 1
    spots = points.where("at >= 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(sizes - 1))).alias("size")).withColumn("cell", F.floor(F.col("at") / F.call_function("shiftleft", F.lit(1).cast("long"), F.col("size"))))
    cut = span.select("*", F.explode(cells(F.col("from"), F.col("to"))).alias("c")).select(*span.columns, F.col("c.size").alias("size"), F.col("c.cell").alias("cell"))
    meet = [*keys, "size", "cell"]
    used = cut.select(*meet).distinct()
    spots = spots.join(used, meet, "left_semi")
    hot = written(spots.groupBy(*meet).agg(F.ceil(F.count("*") / part).cast("int").alias("parts")).where("parts > 1"))
    hot = F.broadcast(hot) if hot.count() <= _HOT_CELLS else hot
    spots = spots.join(hot, meet, "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise((F.rand(7) * F.col("parts")).cast("int"))).drop("parts")
    cut = cut.join(hot, meet, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    both = spots.join(cut, [*meet, "part"]).where((F.col("from") <= F.col("at")) & (F.col("at") <= F.col("to")) & exact)
    return both.drop("size", "cell", "part", "at", "from", "to")


def _coarse(key: Column) -> Column:
    """A whole number that grows with the key: its first number, or the second where the first only tells numbers from letters."""
    return F.greatest(F.lit(0).cast("long"), F.when(F.col("system") == "section", F.get(key, F.lit(0)).cast("long") * (1 << 20) + F.least(F.get(key, F.lit(1)), F.lit((1 << 20) - 1))).otherwise(F.get(key, F.lit(0)).cast("long")))


def overlapping(cited: DataFrame, held: DataFrame, keys: list[str], part: int = PART) -> DataFrame:
    """Pairs of equal keys and system whose locations overlap: rows of cited and held, and `contained`: whether the cited one begins
    within the held one.

    Both have keys, system, value, range_end (null or empty: the value alone) and other columns, which must differ in name; these and
    the keys come out. Ranges written from back to front overlap what location.meet says. Where a location has no ordered form, those
    overlap that share a bound. Null keys, systems or values meet nothing; repeated rows are rows of their own.
    """
    def formed(df: DataFrame, p: str) -> DataFrame:
        form = location.range_form(F.col("system"), F.col("value"), F.nullif(F.col("range_end"), F.lit("")))
        out = df.withColumn(f"{p}f", form).where(F.col(f"{p}f.start").isNotNull()).drop("value", "range_end")
        a, b = F.col(f"{p}f.start_key"), F.col(f"{p}f.end_key")
        return out.withColumn(f"{p}keyed", a.isNotNull() & b.isNotNull()).withColumn(f"{p}proper", F.coalesce(a <= b, F.lit(False)))

    # the forms are used in every join below: made once
    left, right = written(formed(cited, "l")), written(formed(held, "r"))
    both = [*keys, "system"]
    a, b, c, d = F.col("lf.start_key"), F.col("lf.end_key"), F.col("rf.start_key"), F.col("rf.end_key")
    low, other_low = F.least(a, b), F.least(c, d)
    overlap = (a <= d) & (c <= b)
    # ranges as they are, of which the other side's first place is a point
    as_range = lambda df, p: df.where(f"{p}proper").withColumn("from", _coarse(F.col(f"{p}f.start_key"))).withColumn("to", _coarse(F.col(f"{p}f.end_key")))
    as_point = lambda df, p: df.where(f"{p}keyed").withColumn("at", _coarse(F.least(F.col(f"{p}f.start_key"), F.col(f"{p}f.end_key"))))
    within = F.col("lproper") & (a <= other_low)
    found = points_in_ranges(as_point(right, "r"), as_range(left, "l"), both, overlap & within, part)
    found = found.unionByName(points_in_ranges(as_point(left, "l"), as_range(right, "r"), both, overlap & ~within & (low >= c), part))

    def bounds(df: DataFrame, p: str, where: str) -> DataFrame:
        held_bounds = F.array_distinct(F.array(f"{p}f.start", f"{p}f.end"))
        return df.where(where).withColumn(f"{p}bounds", held_bounds).withColumn("bound", F.explode(f"{p}bounds"))

    for here, there in (("not lkeyed", "true"), ("lkeyed", "not rkeyed")):
        pairs = bounds(left, "l", here).join(bounds(right, "r", there), [*both, "bound"])
        once = F.col("bound") == F.array_min(F.array_intersect("lbounds", "rbounds"))
        found = found.unionByName(pairs.where(once).drop("bound", "lbounds", "rbounds"))
    contained = location.within(F.col("rf.start"), F.col("rf.end"), F.col("lf.start"), c, d, a)
    return found.withColumn("contained", contained).drop(*[f"{p}{x}" for p in "lr" for x in ("f", "keyed", "proper")])


def totals(cited: DataFrame, held: DataFrame, keys: list[str], first: str, part: int = PART) -> DataFrame:
    """Rows of cited with any pair of `overlapping`, without their location: n_ranges, how many pairs; n_containing, of how many the cited
    one begins within the held one; first_range, the least `first` of the held ones.

    Rows of equal keys and location are one class on either side. Pairs are made of classes and weigh as much as they have rows, so that
    they grow with the locations that there are and not with the product of the rows.
    """
    place = [*keys, "system", "value", "range_end"]
    # a range without an end is the same whether that is null or empty
    ended = lambda df: df.withColumn("range_end", F.coalesce("range_end", F.lit("")))
    key = F.when(reduce(Column.__and__, [F.col(c).isNotNull() for c in place]), F.to_json(F.array(*[F.col(c).cast("string") for c in place])))
    rows = ended(cited).withColumn("class", key).drop(*place[len(keys) :])
    left = written(ended(cited).where(key.isNotNull()).groupBy(*place).agg(F.count("*").alias("copies")).withColumn("class", key))
    right = ended(held).groupBy(*place).agg(F.count("*").alias("n"), F.min(first).alias("first"))
    pairs = overlapping(left, right, keys, part)
    found = written(pairs.groupBy("class").agg(F.first("copies").alias("copies"), F.sum("n").alias("n_ranges"), F.sum(F.when(F.col("contained"), F.col("n")).otherwise(0)).alias("n_containing"), F.min("first").alias("first_range")))
    return join_by_key(rows.where("class is not null"), found, "class", "copies", left.agg(F.sum("copies")).first()[0] or 0, "inner").drop("class")

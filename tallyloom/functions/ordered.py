"""Rows in a total order across tasks: running sums, and pages from anywhere in the order.

Rows are dealt to tasks by ranges of the whole order, ties included, so a value that half of all rows share is spread like any
other. They are written in order with their place, `at`: the number of the range in the upper bits, the place in it in the
lower 33. Whatever needs the order afterwards reads a table of one row a range, and single ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import stored
from .numbers import MONEY

PLACE_BITS = 33


def in_order(df: DataFrame, *order: str | Column, name: str = "ordered") -> DataFrame:
    """df written in the given order, + at. Equal rows of the order come in any order, the same at each reading."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    return stored(rows, name)


def ranges(rows: DataFrame, *sums: Column) -> DataFrame:
    """(part, n, before, sums) of rows of in_order(): one row a range, `before` the rows of the ranges ahead of it."""
    per = rows.groupBy(F.shiftright("at", PLACE_BITS).alias("part")).agg(F.count(F.lit(1)).alias("n"), *sums)
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    return per.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))


def with_sum_before(df: DataFrame, value: str, tie: str, name: str) -> DataFrame:
    """df with the sum of `value` over the rows before each, in order of falling value, then of tie; exact in decimals of six places."""
    rows = in_order(df.withColumn("x__", F.col(value).cast(MONEY)), F.desc(value), tie)
    zero = F.lit(0).cast(MONEY)
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    parts = ranges(rows, F.sum("x__").alias("s__")).select(F.col("part").alias("p__"), F.coalesce(F.sum("s__").over(ahead), zero).alias("ahead__"))
    part = F.shiftright("at", PLACE_BITS)
    within = F.sum("x__").over(Window.partitionBy(part).orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    out = rows.withColumn("within__", within).join(F.broadcast(parts), part == F.col("p__"))  # a row a range
    return out.withColumn(name, (F.col("ahead__") + F.coalesce("within__", zero)).cast("double")).drop("at", "x__", "p__", "ahead__", "within__")


def page(rows: DataFrame, index: DataFrame, start: int, size: int) -> DataFrame:
    """Rows start .. start + size - 1 of the order. index: ranges(rows). The ranges that the page touches, one or two, come to the driver; the scan gets their places as literals, so other files and row groups are skipped."""
    touched = index.filter((F.col("before") < start + size) & (F.col("before") + F.col("n") > start)).select("part", "n", "before").collect()
    if not touched:
        return rows.limit(0)
    at = F.lit(False)
    for r in touched:
        first = r["part"] << PLACE_BITS
        at |= F.col("at").between(first + max(0, start - r["before"]), first + min(r["n"], start + size - r["before"]) - 1)
    return rows.filter(at)

"""Exact medians of groups of any size, by selection instead of collection.

Doubles keep their order as 64-bit integers. A group's median is found from the top bits down: a map-side count of the rows by
their next bits, a running sum over the counts, and the interval in which the wanted rank lies; rows outside it are out. Three
rounds settle all 64 bits. No task ever holds the values of a group, only counts of intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import stored

#: Bits that stay below the ones that a round tells apart.
SHIFTS = (44, 24, 0)


def ordered_bits(x: Column) -> Column:
    """A double as an integer of the same order; both zeros are alike."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), (x + F.lit(0.0)).cast("double")).cast("long")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(2**63 - 1))).otherwise(bits)


def medians(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, n, median) of the values that aren't null or NaN: the middle one, or the mean of the two in the middle. df is read once for each round and twice more: store it if it is dear."""
    names = [f"k{i}" for i in range(len(keys))] or ["k0"]
    given = [F.col(k).alias(n) for k, n in zip(keys, names, strict=False)] or [F.lit(0).alias("k0")]
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(*given, F.col(value).cast("double").alias("v")).withColumn("b", ordered_bits(F.col("v")))
    other = lambda df: df.select(*[F.col(k).alias(f"o_{k}") for k in names], *[c for c in df.columns if c not in names])
    met = [F.col(k).eqNullSafe(F.col(f"o_{k}")) for k in names]
    n = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    # ranks from 0; `left` is the rank within the interval `at`
    wanted = n.select(*names, F.explode(F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))).alias("rank")).withColumns({"left": F.col("rank"), "at": F.lit(0).cast("long")})
    above = None
    for shift in SHIFTS:
        near, outer = rows, F.lit(0).cast("long")
        if above is not None:
            near = rows.join(other(wanted.select(*names, "at").distinct()), [*met, F.shiftright("b", above) == F.col("at")], "left_semi")
            outer = F.shiftright("bucket", above - shift)
        counts = near.groupBy(*names, F.shiftright("b", shift).alias("bucket")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("low")).withColumn("outer", outer)
        ahead = Window.partitionBy(*names, "outer").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.coalesce(F.sum("c").over(ahead), F.lit(0)))
        inside = (F.col("left") >= F.col("before")) & (F.col("left") < F.col("before") + F.col("c"))
        wanted = wanted.drop("low").join(other(counts), [*met, F.col("at") == F.col("outer"), inside])
        wanted = wanted.select(*names, "rank", (F.col("left") - F.col("before")).alias("left"), F.col("bucket").alias("at"), "low")
        if shift:
            wanted = stored(wanted, "ranks")  # two rows a group at most; without it each round would run the rounds before it again
        above = shift
    middle = wanted.groupBy(*names).agg(F.min("low").alias("a"), F.max("low").alias("z"))
    out = n.join(other(middle), met).select(*names, "n", (F.col("a") / 2 + F.col("z") / 2).alias("median"))
    return out.select(*[F.col(m).alias(k) for k, m in zip(keys, names, strict=False)], "n", "median")

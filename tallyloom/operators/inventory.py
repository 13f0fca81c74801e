"""Inventory: velocity, trend, ABC class, ageing and reorder priority of items, in one aggregate over the slice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fields import ABC, AGEING
from ..functions.numbers import clamp, div, exact_sum
from ..functions.ordered import with_sum_before
from .derive import derived

WEIGHTS = {"velocity": 0.5, "trend": 0.3, "recency": 0.2}
TREND = (0.25, 4.0)
RECENCY_DAYS = 60
COVER_DAYS = 7


def ageing_bucket(idle: Column) -> Column:
    a, b, c = AGEING
    return F.when(idle <= a, f"0-{a}").when(idle <= b, f"{a + 1}-{b}").when(idle <= c, f"{b + 1}-{c}").otherwise(f"{c}+")


def items(df: DataFrame, order: list[str], only_late: float = TREND[1], only_early: float = TREND[0], neither: float = 1.0) -> DataFrame:
    """One row an item. The slice's own first and last sale set its window and thirds; stock is the latest known by date and row order."""
    day = F.col("sale_date").cast("date")
    span = df.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day")).withColumn("window_days", F.datediff("last_day", "first_day") + 1).withColumn("third", F.greatest(F.floor(F.col("window_days") / 3), F.lit(1)).cast("int"))
    d = derived(df).crossJoin(F.broadcast(span))  # one row
    q = F.col("quantity")
    early, late = day < F.date_add("first_day", F.col("third")), day >= F.date_sub(F.date_add("last_day", 1), F.col("third"))
    first = F.struct("sale_date", *order)
    latest = [F.max_by(F.when(F.col("stock_on_hand").isNotNull(), F.col("stock_on_hand")), F.when(F.col("stock_on_hand").isNotNull(), first)).alias("stock")] if "stock_on_hand" in df.columns else []
    sums = d.groupBy("item", "window_days", "last_day").agg(
        F.min_by("category", F.struct(*order)).alias("category"), exact_sum(q).alias("units"), exact_sum(F.col("row_revenue")).alias("revenue"), F.max(day).alias("last_sale"), F.count_distinct(day).alias("active_days"),
        div(exact_sum(F.col("cost_price")), F.count("cost_price")).alias("mean_cost"), F.coalesce(exact_sum(F.when(early, q)), F.lit(0.0)).alias("early"), F.coalesce(exact_sum(F.when(late, q)), F.lit(0.0)).alias("late"), *latest,
    )
    factor = F.when((F.col("early") > 0) & (F.col("late") > 0), F.col("late") / F.col("early")).when(F.col("late") > 0, only_late).when(F.col("early") > 0, only_early).otherwise(neither)
    return sums.select(
        "*", (F.col("units") / F.col("window_days")).alias("velocity"), (F.col("units") / F.col("active_days")).alias("velocity_active"),
        F.datediff("last_day", "last_sale").alias("days_idle"), clamp(factor, *TREND).alias("trend"),
    )


def with_abc(rows: DataFrame) -> DataFrame:
    """abc: by the share of revenue before the item, in order of revenue; all C where there is no revenue."""
    total = exact_sum(F.col("revenue")).alias("total__")
    rows = with_sum_before(rows, "revenue", "item", "before__")
    rows = rows.crossJoin(F.broadcast(rows.agg(total)))  # one row
    share = F.col("before__") / F.when(F.col("total__") > 0, F.col("total__"))
    return rows.withColumn("abc", F.when(share < ABC[0], "A").when(share < ABC[1], "B").otherwise("C")).drop("before__", "total__")


def intelligence(df: DataFrame, order: list[str]) -> DataFrame:
    """The items of a slice with abc, ageing, priority (0 to 100), days of cover, reorder flag and locked capital."""
    rows = with_abc(items(df, order))
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max("velocity").alias("fastest"))))  # one row
    v = F.coalesce(div(F.col("velocity"), F.col("fastest")), F.lit(0.0))
    t = clamp((F.col("trend") - TREND[0]) / (TREND[1] - TREND[0]), 0, 1)
    r = clamp(1 - F.col("days_idle") / RECENCY_DAYS, 0, 1)
    priority = 100 * (WEIGHTS["velocity"] * v + WEIGHTS["trend"] * t + WEIGHTS["recency"] * r)
    out = rows.withColumn("priority", priority.cast("decimal(20,6)").cast("double")).withColumn("ageing", ageing_bucket(F.col("days_idle")))
    if "stock_on_hand" in df.columns:
        out = out.withColumn("days_cover", div(F.col("stock"), F.col("velocity"))).withColumn("reorder", F.col("days_cover") < COVER_DAYS).withColumn("capital", F.col("stock") * F.col("mean_cost"))
    return out.drop("window_days", "last_day", "early", "late", "fastest")


def ranked(df: DataFrame, order: list[str], n: int = 50) -> DataFrame:
    return intelligence(df, order).orderBy(F.desc("priority"), "item").limit(max(1, min(n, 200)))


def buckets(df: DataFrame, order: list[str], by: str) -> DataFrame:
    """(bucket, item_count, units, revenue, revenue_share) by abc (always three rows) or ageing."""
    rows = intelligence(df, order)
    sums = rows.groupBy(F.col(by).alias("bucket")).agg(F.count(F.lit(1)).alias("item_count"), exact_sum(F.col("units")).alias("units"), exact_sum(F.col("revenue")).alias("revenue"))
    if by == "abc":
        sums = df.sparkSession.createDataFrame([("A",), ("B",), ("C",)], "bucket string").join(sums, "bucket", "left").fillna(0, ["item_count"]).fillna(0.0, ["units", "revenue"])
    total = F.sum(F.col("revenue").cast("decimal(20,6)")).over(Window.partitionBy()).cast("double")
    return sums.withColumn("revenue_share", F.coalesce(div(F.col("revenue"), total) * 100, F.lit(0.0)))


def item_demand(df: DataFrame, order: list[str], horizon: int, n: int = 20) -> DataFrame:
    """(item, expected): velocity * trend * horizon of the items that sell most; the trend of an item sold only late is 2, and 0.5 otherwise."""
    rows = items(df, order, only_late=2.0, only_early=0.5, neither=0.5).orderBy(F.desc("units"), "item").limit(n)
    return rows.select("item", "units", "trend", (F.col("velocity") * F.col("trend") * horizon).alias("expected"))


def with_demand(rows: DataFrame, demand: DataFrame) -> DataFrame:
    """intelligence() rows with the units expected of the items that have a forecast."""
    return rows.join(demand.select("item", "expected"), "item", "left")


def resorted(rows: DataFrame, column: str, ascending: bool = False, n: int = 12) -> DataFrame:
    """The first n rows by a column; a missing value counts as 0."""
    key = F.coalesce(F.col(column), F.lit(0.0))
    return rows.orderBy(key.asc() if ascending else key.desc(), "item").limit(n)

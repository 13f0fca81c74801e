"""Grouped charts with shares, Pareto counts and a folded tail; heatmaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fields import MEASURES, PARETO, TIME_DIMENSIONS, TOP_N, WEEKDAYS, QueryError
from ..functions.numbers import div, exact_sum, percent
from ..functions.ordered import with_sum_before
from .derive import derived
from .slicing import facets, role

PARTS = ["revenue", "cost", "profit", "discount", "units", "transactions"]


def group_key(dimension: str) -> Column:
    day = F.col("sale_date")
    if dimension == "day":
        return F.date_format(day, "yyyy-MM-dd")
    if dimension == "weekday":
        return F.date_format(day, "EEE")
    if dimension == "month":
        return F.date_format(day, "yyyy-MM")
    return F.col(dimension).cast("string")


def totals(df: DataFrame) -> list[Column]:
    """Aggregates of a derived register, as PARTS."""
    units = exact_sum(F.col("quantity")) if "quantity" in df.columns else F.lit(None).cast("double")
    return [
        exact_sum(F.col("row_revenue")).alias("revenue"), exact_sum(F.col("row_cost")).alias("cost"), exact_sum(F.col("row_profit")).alias("profit"),
        exact_sum(F.col("row_discount")).alias("discount"), units.alias("units"), F.count(F.lit(1)).alias("transactions"),
    ]


def measure_value(measure: str) -> Column:
    """A measure from the sums of PARTS: ratios are ratios of sums."""
    if measure == "margin_pct":
        return F.coalesce(percent(F.col("profit"), F.col("revenue")), F.lit(0.0))
    if measure == "avg_price":
        return F.coalesce(div(F.col("revenue"), F.col("units")), F.lit(0.0))
    return F.col(measure).cast("double")


def grouped(df: DataFrame, dimension: str) -> DataFrame:
    """(label, PARTS) of a register: one map-side aggregate and one shuffle of groups."""
    d = derived(df)
    return d.groupBy(group_key(dimension).alias("label")).agg(*totals(d))


def chart(df: DataFrame, dimension: str, measure: str, top_n: int = TOP_N) -> DataFrame:
    """(position, label, value, share, cumulative, total, group_count, pareto_count, is_other) of a slice.

    Other dimensions than time are ordered by value, ties by label, and what follows the first top_n is folded to one
    point; time runs in its own order, whole. Shares, cumulative shares and the Pareto count (the groups that make up 80 %) are
    for additive measures only. Groups can be as many as there are invoices: the head is a top-k, the tail an aggregate, and no
    window holds all groups but those of time.
    """
    if measure not in MEASURES:
        raise QueryError(f"no measure {measure}")
    if dimension not in TIME_DIMENSIONS and dimension not in facets(df):
        raise QueryError(f"no dimension {dimension}")
    additive = MEASURES[measure][0]
    timed = dimension in TIME_DIMENSIONS
    groups = grouped(df, dimension).withColumn("value", measure_value(measure))
    if additive and not timed:
        groups = with_sum_before(groups, "value", "label", "before")  # written once, in order: all that follows reads that table
    sums = [F.sum(p).alias(p) if p == "transactions" else exact_sum(F.col(p)).alias(p) for p in PARTS]
    whole = groups.agg(*sums, exact_sum(F.col("value")).alias("sum_of_values"), F.count(F.lit(1)).alias("group_count"))
    whole = whole.select((F.col("sum_of_values") if additive else measure_value(measure)).alias("total"), "group_count")
    if timed:
        in_order = F.col("label")
        if dimension == "weekday":
            in_order = F.array_position(F.array(*[F.lit(d) for d in WEEKDAYS]), in_order)
        points = groups.withColumn("position", F.row_number().over(Window.orderBy(in_order)))  # days, months or weekdays
        whole = whole.withColumn("pareto_count", F.lit(None).cast("long"))
    else:
        if additive:
            reached = groups.crossJoin(F.broadcast(whole)).filter(~F.coalesce(div(F.col("before"), F.col("total")) >= PARETO, F.lit(False)))  # one row
            pareto = reached.agg(F.count(F.lit(1)).alias("n"))
            whole = whole.crossJoin(pareto).withColumn("pareto_count", F.when(F.col("total") > 0, F.col("n"))).drop("n")  # one row each
        else:
            whole = whole.withColumn("pareto_count", F.lit(None).cast("long"))
        head = groups.orderBy(F.desc("value"), "label").limit(top_n)
        head = head.withColumn("position", F.row_number().over(Window.orderBy(F.desc("value"), "label")))  # top_n rows
        named = F.broadcast(head.select(F.col("label").alias("head_label")))
        tail = groups.join(named, F.col("label").eqNullSafe(F.col("head_label")), "left_anti").agg(*sums, F.count(F.lit(1)).alias("k")).filter("k > 0")
        tail = tail.withColumn("value", measure_value(measure)).withColumn("label", F.concat(F.lit("Other ("), F.col("k").cast("string"), F.lit(")"))).withColumn("position", F.lit(top_n + 1))
        points = head.select("position", "label", "value").unionByName(tail.select("position", "label", "value"))
    points = points.select("position", "label", "value").crossJoin(F.broadcast(whole))  # one row
    share = cumulative = F.lit(None).cast("double")
    if additive:
        running = F.sum(F.col("value").cast("decimal(20,6)")).over(Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)).cast("double")
        share, cumulative = percent(F.col("value"), F.col("total")), percent(running, F.col("total"))
    is_other = F.lit(False) if timed else F.col("position") > top_n
    return points.select(F.col("position").cast("long").alias("position"), "label", "value", share.alias("share"), cumulative.alias("cumulative"), "total", "group_count", "pareto_count", is_other.alias("is_other"))


def extra_measure(df: DataFrame, dimension: str, column: str, average: bool) -> DataFrame:
    """(label, value, n) of an extra column; a mean keeps its count, so that a tail folds by weight."""
    if role(df, column) != "x_meas":
        raise QueryError(f"no measure {column}")
    x = F.col(column)
    value = div(exact_sum(x), F.count(x)) if average else exact_sum(x)
    return df.groupBy(group_key(dimension).alias("label")).agg(value.alias("value"), F.count(x).alias("n"))


def heatmap(df: DataFrame, measure: str) -> DataFrame:
    """(week_start, weekday, value, intensity): the measure by ISO week and weekday; cells without sales are left out.

    Weeks are keyed on their Monday. Intensity runs from 0.08 to 1 between the least and the largest cell.
    """
    d = derived(df)
    cells = d.groupBy(F.date_trunc("week", "sale_date").cast("date").alias("week_start"), F.date_format("sale_date", "EEE").alias("weekday")).agg(*totals(d)).withColumn("value", measure_value(measure))
    w = Window.partitionBy()
    low, high = F.min("value").over(w), F.max("value").over(w)
    return cells.select("week_start", week_label(F.col("week_start")).alias("week"), "weekday", "value", (0.08 + 0.92 * F.coalesce(div(F.col("value") - low, high - low), F.lit(0.0))).alias("intensity"))


def week_label(x: Column) -> Column:
    """The ISO week of a day: W01 to W53."""
    return F.concat(F.lit("W"), F.lpad(F.weekofyear(x).cast("string"), 2, "0"))


def heatmap_grid(df: DataFrame, measure: str) -> DataFrame:
    """All seven weekdays of each week that has a cell, 0 where there is none: weeks times seven rows."""
    cells = heatmap(df, measure).select("week_start", "weekday", "value")
    weeks = cells.select("week_start").distinct().withColumn("weekday", F.explode(F.array(*[F.lit(d) for d in ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")])))
    return weeks.join(cells, ["week_start", "weekday"], "left").select("week_start", "weekday", F.coalesce("value", F.lit(0.0)).alias("value"))


#: Kinds of chart that don't show a run of time.
NOT_FOR_TIME = ["donut", "pareto", "scatter", "treemap"]
SLICES = 6


def requested(df: DataFrame, kind: str, dimension: str, measure: str) -> DataFrame:
    """The chart for a kind of picture: a donut has SLICES slices, and kinds that don't show time fall back to categories."""
    if kind in NOT_FOR_TIME and dimension in ("day", "month"):
        dimension = "category"
    return chart(df, dimension, measure, SLICES if kind == "donut" else TOP_N)


def treemap_cells(points: DataFrame) -> DataFrame:
    return points.filter("value > 0")


def bubbles(points: DataFrame, price: str) -> DataFrame:
    """Points that are groups of their own and have a price."""
    return points.filter(~F.col("is_other") & F.col(price).isNotNull())

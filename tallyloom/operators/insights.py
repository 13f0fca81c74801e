"""Findings over a slice: each a small table, empty where there is nothing to say."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import div, exact_sum, percent
from ..functions.ordered import with_sum_before
from ..functions.selection import medians
from ..sources.stored import stored
from .derive import derived
from .reports import daily

Z_WARNING, Z_CRITICAL, MIN_DAYS, SPARSE, MAD_SCALE = 2.0, 3.0, 7, 0.25, 0.6745
MOVER, LEAK_SHARE, LEAK_GAP, LEAK_ITEMS = 1.0, 0.03, 10.0, 3
CONCENTRATION, CONCENTRATION_ITEMS = 0.20, 8
WEEKDAY_SEEN, WEEKDAY_RATIO, DEAD_DAYS = 2, 1.3, 30
LEADER_GAP, LEADER_ITEMS, MARGIN_GAP, TOP_REVENUE, PAYMENT_SHARE = 3.0, 3, 5.0, 3, 50.0


def everything():
    """The window of all rows of a frame that is already an aggregate."""
    return Window.partitionBy()


def anomalies(df: DataFrame) -> DataFrame:
    """(day, revenue, z, severity) of days whose revenue is far from the median, by median absolute deviation.

    Where over a quarter of the days have no sales, only trading days count. Where half the days are alike (deviation 0), the
    standard deviation takes its place. Fewer than seven days, a median of 0 or no spread: none.
    """
    days = daily(df).select("day", "revenue")
    days = days.withColumn("sparse", F.avg((F.col("revenue") <= 0).cast("double")).over(everything()) > SPARSE).filter(~F.col("sparse") | (F.col("revenue") > 0))
    days = days.withColumn("n", F.count(F.lit(1)).over(everything())).filter(F.col("n") >= MIN_DAYS)
    one = days.agg(F.percentile("revenue", F.lit(0.5)).alias("med"), F.stddev_pop("revenue").cast("decimal(20,6)").cast("double").alias("sd"))
    days = days.crossJoin(F.broadcast(one)).filter("med > 0")  # one row
    mad = days.agg(F.percentile(F.abs(F.col("revenue") - F.col("med")), F.lit(0.5)).alias("mad"))
    days = days.crossJoin(F.broadcast(mad))  # one row
    z = F.when(F.col("mad") > 0, MAD_SCALE * (F.col("revenue") - F.col("med")) / F.col("mad")).otherwise(div(F.col("revenue") - F.col("med"), F.col("sd")))
    found = days.withColumn("z", z).filter(F.abs("z") >= Z_WARNING)
    severity = F.when(F.abs("z") >= Z_CRITICAL, "critical").when(F.col("z") < 0, "warning").otherwise("positive")
    return found.select("day", "revenue", "z", severity.alias("severity"))


def anomalous_days(days: DataFrame, found: DataFrame) -> DataFrame:
    """The days of a daily series that anomalies() names."""
    return days.join(found.select("day"), "day", "left_semi")


def _item_sums(df: DataFrame) -> DataFrame:
    return derived(df).groupBy("item").agg(exact_sum(F.col("row_revenue")).alias("revenue"), exact_sum(F.col("row_cost")).alias("cost"), exact_sum(F.col("row_profit")).alias("profit"))


def movers(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(item, change): the largest gain and the largest drop in revenue, among items sold in both periods."""
    change = _item_sums(current).select("item", F.col("revenue").alias("cur")).join(_item_sums(previous).select("item", F.col("revenue").alias("prev")), "item")
    change = change.select("item", (F.col("cur") - F.col("prev")).cast("decimal(20,6)").cast("double").alias("change"))
    best = change.agg(F.max(F.struct("change", F.col("item").alias("item"))).alias("up"), F.min(F.struct("change", "item")).alias("down"))
    both = best.select(F.explode(F.array("up", "down")).alias("m"), F.col("up").alias("u")).select("m.item", "m.change", (F.col("m") == F.col("u")).alias("is_up"))
    return both.filter((F.col("is_up") & (F.col("change") > MOVER)) | (~F.col("is_up") & (F.col("change") < -MOVER))).select("item", "change").distinct()


def margin_leaks(df: DataFrame) -> DataFrame:
    """(item, margin, benchmark, gap) of items with at least 3 % of revenue whose margin is far below their category's median.

    Categories of fewer than three items are held against the median of all items; a loss counts as its size and 100 more.
    """
    d = derived(df)
    rows = d.groupBy("item").agg(F.min("category").alias("category"), exact_sum(F.col("row_revenue")).alias("revenue"), exact_sum(F.col("row_profit")).alias("profit")).filter("revenue > 0")
    total = rows.agg(exact_sum(F.col("revenue")).alias("total"))
    rows = rows.crossJoin(F.broadcast(total)).withColumn("margin", percent(F.col("profit"), F.col("revenue"))).withColumn("share", F.col("revenue") / F.col("total"))  # one row
    rows = stored(rows, "margins")
    scopes = F.array(F.struct(F.lit(True).alias("is_category"), F.col("category").alias("c")), F.struct(F.lit(False).alias("is_category"), F.lit(None).cast("string").alias("c")))
    middle = stored(medians(rows.select("margin", F.explode(scopes).alias("s")).select("margin", "s.*"), "margin", "is_category", "c"), "medians")
    by_category = middle.filter("is_category").select("c", F.col("median").alias("category_median"), "n")
    shop = middle.filter("not is_category").select(F.col("median").alias("shop_median"))
    rows = rows.join(by_category, F.col("category").eqNullSafe(F.col("c"))).crossJoin(F.broadcast(shop))  # one row
    rows = rows.withColumn("benchmark", F.when(F.col("n") >= LEAK_ITEMS, F.col("category_median")).otherwise(F.col("shop_median")))
    gap = F.when(F.col("margin") < 0, F.abs("margin") + 100).otherwise(F.col("benchmark") - F.col("margin"))
    return rows.withColumn("gap", gap).filter((F.col("share") >= LEAK_SHARE) & (F.col("gap") >= LEAK_GAP)).select("item", "margin", "benchmark", "gap")


def discount_leader(df: DataFrame) -> DataFrame:
    """(item, discount_pct, overall_pct): the item sold furthest below MRP, if by 3 points more than all together and of three items or more."""
    fine = df.filter((F.col("mrp") > 0) & (F.col("selling_price") <= F.col("mrp")))
    given, listed = exact_sum((F.col("mrp") - F.col("selling_price")) * F.col("quantity")), exact_sum(F.col("mrp") * F.col("quantity"))
    rows = fine.groupBy("item").agg(given.alias("given"), listed.alias("listed")).filter("listed > 0")
    whole = rows.agg(percent(exact_sum(F.col("given")), exact_sum(F.col("listed"))).alias("overall_pct"), F.count(F.lit(1)).alias("n"))
    first = rows.withColumn("discount_pct", percent(F.col("given"), F.col("listed"))).orderBy(F.desc("discount_pct"), "item").limit(1)
    return first.crossJoin(F.broadcast(whole)).filter((F.col("n") >= LEADER_ITEMS) & (F.col("discount_pct") - F.col("overall_pct") >= LEADER_GAP)).select("item", "discount_pct", "overall_pct")  # one row


def margin_gaps(df: DataFrame) -> DataFrame:
    """(item, margin, overall): which of the three items of largest revenue earn 5 points less than the whole."""
    rows = _item_sums(df)
    whole = rows.agg(percent(exact_sum(F.col("profit")), exact_sum(F.col("revenue"))).alias("overall"))
    top = rows.orderBy(F.desc("revenue"), "item").limit(TOP_REVENUE).withColumn("margin", percent(F.col("profit"), F.col("revenue")))
    return top.crossJoin(F.broadcast(whole)).filter(F.col("margin") < F.col("overall") - MARGIN_GAP).select("item", "margin", "overall")  # one row


def payment_mix(df: DataFrame) -> DataFrame:
    """(payment_mode, revenue, share, margin): modes in order of revenue, with is_dominant for one with half of it or more."""
    d = derived(df)
    rows = d.groupBy("payment_mode").agg(exact_sum(F.col("row_revenue")).alias("revenue"), exact_sum(F.col("row_profit")).alias("profit"))
    rows = rows.withColumn("share", percent(F.col("revenue"), F.sum(F.col("revenue").cast("decimal(20,6)")).over(everything()).cast("double"))).withColumn("margin", percent(F.col("profit"), F.col("revenue")))
    return rows.select("payment_mode", "revenue", "share", "margin", (F.col("share") >= PAYMENT_SHARE).alias("is_dominant"))


def concentration(df: DataFrame) -> DataFrame:
    """One row: items with revenue, how many make up 80 % of it, and whether that is at most a fifth of eight items or more."""
    rows = _item_sums(df).filter("revenue > 0")
    rows = with_sum_before(rows, "revenue", "item", "before")
    rows = rows.crossJoin(F.broadcast(rows.agg(exact_sum(F.col("revenue")).alias("total"))))  # one row
    running = (F.col("before").cast("decimal(20,6)") + F.col("revenue").cast("decimal(20,6)")).cast("double") / F.col("total")
    one = rows.withColumn("running", running).agg(F.count(F.lit(1)).alias("n_items"), (F.count_if(F.col("running") < 0.80) + 1).alias("n_needed"))
    return one.select("n_items", "n_needed", ((F.col("n_items") >= CONCENTRATION_ITEMS) & (F.col("n_needed") / F.col("n_items") <= CONCENTRATION)).alias("is_concentrated"))


def weekday_timing(df: DataFrame) -> DataFrame:
    """(weekday, mean_revenue, days, is_best, is_worst): mean revenue of the days that traded, by weekday, where each was seen twice."""
    d = derived(df)
    days = d.groupBy(F.col("sale_date").cast("date").alias("day")).agg(exact_sum(F.col("row_revenue")).alias("revenue"))
    rows = days.groupBy(F.date_format("day", "EEE").alias("weekday")).agg(div(exact_sum(F.col("revenue")), F.count(F.lit(1))).alias("mean_revenue"), F.count(F.lit(1)).alias("days")).filter(F.col("days") >= WEEKDAY_SEEN)
    best, worst = F.row_number().over(Window.orderBy(F.desc("mean_revenue"), "weekday")), F.row_number().over(Window.orderBy("mean_revenue", "weekday"))
    return rows.select("weekday", "mean_revenue", "days", (best == 1).alias("is_best"), (worst == 1).alias("is_worst"))


def dead_stock(df: DataFrame) -> DataFrame:
    """(item, days_idle, revenue) of items not sold in the last 30 days of the slice."""
    d = derived(df)
    rows = d.groupBy("item").agg(F.max(F.col("sale_date").cast("date")).alias("last_sale"), exact_sum(F.col("row_revenue")).alias("revenue"))
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max("last_sale").alias("last"))))  # one row
    return rows.withColumn("days_idle", F.datediff("last", "last_sale")).filter(F.col("days_idle") >= DEAD_DAYS).select("item", "days_idle", "revenue")


SEVERITY = {"critical": 0, "warning": 1, "positive": 2, "neutral": 3}


def insights(current: DataFrame, previous: DataFrame, least_rows: int = 30, most: int = 6) -> DataFrame:
    """(kind, subject, severity, impact): the first findings by severity, then size. Checks of items need 30 rows."""
    enough = current.agg((F.count(F.lit(1)) >= least_rows).alias("enough"))
    row = lambda df, kind, subject, severity, impact: df.select(F.lit(kind).alias("kind"), subject.cast("string").alias("subject"), severity.alias("severity"), impact.cast("double").alias("impact"))
    c, lit = F.col, F.lit
    found = [
        row(anomalies(current).orderBy(F.desc(F.abs("z")), "day").limit(2), "anomaly", c("day"), c("severity"), F.abs("z")),
        row(movers(current, previous), "mover", c("item"), F.when(c("change") > 0, "positive").otherwise("warning"), F.abs("change")),
        row(margin_leaks(current).orderBy(F.desc("gap"), "item").limit(1), "margin leak", c("item"), lit("critical"), c("gap")),
        row(dead_stock(current).orderBy(F.desc("days_idle"), "item").limit(1), "dead stock", c("item"), lit("warning"), c("days_idle")),
        row(weekday_timing(current).filter("is_best"), "best weekday", c("weekday"), lit("neutral"), c("mean_revenue")),
    ]
    small = [
        row(discount_leader(current), "discount leader", c("item"), lit("warning"), c("discount_pct")),
        row(margin_gaps(current), "margin gap", c("item"), lit("warning"), c("overall") - c("margin")),
        row(payment_mix(current).filter("is_dominant"), "payment mix", c("payment_mode"), lit("neutral"), c("share")),
        row(concentration(current).filter("is_concentrated"), "concentration", c("n_needed"), lit("warning"), c("n_items")),
    ]
    found += [x.crossJoin(F.broadcast(enough)).filter("enough").drop("enough") for x in small]  # one row
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    rank = F.element_at(F.create_map(*[lit(x) for kv in SEVERITY.items() for x in kv]), c("severity"))
    return out.orderBy(rank, F.desc("impact"), "kind", "subject").limit(most)

"""KPI, daily series, profit and loss, ledgers, discounts and their reconciliation. All take a slice of the register."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fields import MAX_PAGE_SIZE, PAGE_SIZE, UNSPECIFIED
from ..functions.numbers import div, exact_sum, percent
from ..functions.ordered import in_order, page as page_of, ranges
from .charts import totals
from .derive import derived
from .slicing import Slice

def day() -> Column:
    return F.col("sale_date").cast("date")


def kpi(current: DataFrame, previous: DataFrame) -> DataFrame:
    """One row: totals of both periods, distinct items, and changes in percent (0 if the earlier period has none)."""

    def sums(df: DataFrame, name: str) -> DataFrame:
        d = derived(df)
        items = F.count_distinct(F.when(F.col("item") != UNSPECIFIED, F.col("item"))) if "item" in df.columns else F.lit(None).cast("long")
        return d.agg(*[F.coalesce(c, F.lit(0)).alias(f"{name}_{n}") for c, n in zip(totals(d), ("revenue", "cost", "profit", "discount", "units", "transactions"), strict=True)], items.alias(f"{name}_items"))

    out = sums(current, "cur").crossJoin(sums(previous, "prev"))  # one row each
    change = lambda m: F.coalesce(percent(F.col(f"cur_{m}") - F.col(f"prev_{m}"), F.col(f"prev_{m}")), F.lit(0.0)).alias(f"{m}_change")
    return out.select(
        *[f"{p}_{m}" for p in ("cur", "prev") for m in ("revenue", "cost", "profit", "units")], "cur_items", *[change(m) for m in ("revenue", "cost", "profit", "units")],
        F.coalesce(percent(F.col("cur_profit"), F.col("cur_revenue")), F.lit(0.0)).alias("margin_pct"), percent(F.col("cur_cost"), F.col("cur_revenue")).alias("cost_pct"), div(F.col("cur_units"), F.col("cur_items")).alias("units_per_item"),
    )


def daily(df: DataFrame) -> DataFrame:
    """(day, transactions, units, revenue, cost, profit, margin_pct) of each calendar day from the first to the last sale, 0 where there is none."""
    d = derived(df)
    sums = d.groupBy(day().alias("day")).agg(*totals(d))
    calendar = df.agg(F.min(day()).alias("a"), F.max(day()).alias("b")).filter("a is not null").select(F.explode(F.sequence("a", "b")).alias("day"))
    filled = calendar.join(sums, "day", "left").fillna(0.0, ["units", "revenue", "cost", "profit"]).fillna(0, ["transactions"])
    return filled.select("day", "transactions", "units", "revenue", "cost", "profit", F.coalesce(percent(F.col("profit"), F.col("revenue")), F.lit(0.0)).alias("margin_pct"))


def trailing_mean(series: DataFrame, days: int = 7) -> DataFrame:
    """(day, revenue, mean_7): mean of the last days, null until there are so many. The series has a row a day."""
    w = Window.orderBy("day").rowsBetween(1 - days, 0)
    total = F.sum(F.col("revenue").cast("decimal(20,6)")).over(w).cast("double")
    return series.select("day", "revenue", F.when(F.count("day").over(w) == days, total / days).alias("mean_7"))


def category_ledger(df: DataFrame, key: str = "category") -> DataFrame:
    d = derived(df)
    sums = d.groupBy(F.col(key).alias("label")).agg(*totals(d))
    return sums.select("label", "units", "revenue", "cost", "profit", F.coalesce(percent(F.col("profit"), F.col("revenue")), F.lit(0.0)).alias("margin_pct"))


def ledger_total(df: DataFrame) -> DataFrame:
    """The category ledger's last row, and the mean revenue a day."""
    d = derived(df)
    return d.agg(*totals(d), F.count_distinct(day()).alias("days")).select("units", "revenue", "cost", "profit", percent(F.col("profit"), F.col("revenue")).alias("margin_pct"), div(F.col("revenue"), F.col("days")).alias("revenue_per_day"))


def revenue_mix(df: DataFrame, slices: int = 6) -> DataFrame:
    """(label, revenue, share): the largest categories with positive revenue, and their share of all positive revenue."""
    positive = category_ledger(df).filter("revenue > 0")
    share = percent(F.col("revenue"), F.sum(F.col("revenue").cast("decimal(20,6)")).over(Window.partitionBy()).cast("double"))
    return positive.select("label", "revenue", share.alias("share")).orderBy(F.desc("revenue"), "label").limit(slices)


def top_items(df: DataFrame, n: int = 5) -> DataFrame:
    """The best-selling items by quantity, or by revenue where quantities are unknown."""
    d = derived(df)
    sums = d.groupBy("item").agg(*totals(d))
    by = "units" if "quantity" in df.columns else "revenue"
    return sums.select("item", "units", "revenue").orderBy(F.desc(by), "item").limit(n)


def slow_items(df: DataFrame, most_units: float = 5.0) -> DataFrame:
    """Items that sold at most so many units in the slice, with the days since they last sold."""
    sums = df.groupBy("item").agg(exact_sum(F.col("quantity")).alias("units"), F.max(day()).alias("last_sale"))
    sums = sums.crossJoin(F.broadcast(sums.agg(F.max("last_sale").alias("last"))))  # one row
    return sums.withColumn("days_idle", F.datediff("last", "last_sale")).filter(F.col("units") <= most_units).drop("last")


def profit_and_loss(df: DataFrame) -> DataFrame:
    """(position, line, amount, pct): the statement's lines in order; percentages are of net revenue.

    Discounts show as a line only where the register has them, tax as a memo if there is any; cost and profit are null
    where they are unknown.
    """
    d = derived(df)
    given = exact_sum(F.col("row_discount")) if "discount" in df.columns else F.lit(0.0)
    one = d.agg(exact_sum(F.col("row_revenue")).alias("net"), given.alias("given"), exact_sum(F.col("row_cost")).alias("cost"), exact_sum(F.col("row_profit")).alias("profit"), exact_sum(F.col("row_tax")).alias("tax"))
    line = lambda i, name, amount, shown=F.lit(True): F.when(shown, F.struct(F.lit(i).alias("position"), F.lit(name).alias("line"), amount.alias("amount")))
    some, none = F.col("given") > 0, F.coalesce(F.col("given"), F.lit(0.0)) <= 0
    lines = F.array(
        line(1, "Gross Sales", F.col("net") + F.col("given"), some), line(2, "Less: Discounts Allowed", -F.col("given"), some), line(3, "Net Revenue", F.col("net"), some),
        line(1, "Gross Revenue", F.col("net"), none), line(4, "Cost of Goods Sold", F.col("cost")), line(5, "Gross Profit", F.col("profit")), line(6, "Tax Collected (memo)", F.col("tax"), F.col("tax") > 0),
    )
    return one.select("net", F.explode(F.filter(lines, lambda x: x.isNotNull())).alias("l")).select("l.*", percent(F.col("l.amount"), F.col("net")).alias("pct"))


def ledger_page(df: DataFrame, order: list[str], page: int = 1, page_size: int = PAGE_SIZE) -> DataFrame:
    """Rows of one page by date and row order. Only the rows up to the page's end are kept in the sort."""
    size = max(1, min(page_size, MAX_PAGE_SIZE))
    return derived(df).orderBy("sale_date", *order).offset((max(1, page) - 1) * size).limit(size)


def ledger_index(df: DataFrame, order: list[str], columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of a slice in the ledger's order, written once, and the table of their ranges: any page is then read without a sort.

    columns: those that pages show beside the order, all if none are named; no others are moved and written.
    """
    rows = derived(df)
    if columns is not None:
        rows = rows.select(*dict.fromkeys(["sale_date", *columns, *order]))
    rows = in_order(rows, "sale_date", *order, name="ledger")
    return rows, ranges(rows)


def indexed_page(rows: DataFrame, index: DataFrame, page: int, page_size: int = PAGE_SIZE) -> DataFrame:
    """One page of ledger_index(), + page. A page beyond the last is the last, as in ledger_pages()."""
    size = max(1, min(page_size, MAX_PAGE_SIZE))
    n = index.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    page = max(1, min(page, -(-n // size)))
    return page_of(rows, index, (page - 1) * size, size).drop("at").withColumn("page", F.lit(page).cast("long"))


def ledger_pages(df: DataFrame, page: int, page_size: int = PAGE_SIZE) -> DataFrame:
    """One row: rows, pages and the page that a request for `page` gets."""
    size = max(1, min(page_size, MAX_PAGE_SIZE))
    pages = F.greatest(F.ceil(F.col("n_rows") / size), F.lit(1))
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", pages.alias("total_pages"), F.least(F.greatest(F.lit(page), F.lit(1)), pages).alias("page"))


def discount_metrics(df: DataFrame) -> DataFrame:
    """One row: discount given, its share of MRP value, and rows with a usable MRP, without one, and sold above it."""
    d = df.withColumn("usable", F.col("mrp").isNotNull() & (F.col("mrp") > 0))
    fine = F.col("usable") & (F.col("selling_price") <= F.col("mrp"))
    given = exact_sum(F.when(fine, (F.col("mrp") - F.col("selling_price")) * F.col("quantity")))
    listed = exact_sum(F.when(fine, F.col("mrp") * F.col("quantity")))
    return d.agg(F.coalesce(given, F.lit(0.0)).alias("given"), F.coalesce(percent(given, listed), F.lit(0.0)).alias("pct_of_mrp"), F.count_if(fine).alias("valid_rows"), F.count_if(~F.col("usable")).alias("missing_rows"), F.count_if(F.col("usable") & (F.col("selling_price") > F.col("mrp"))).alias("above_mrp_rows"))


def discount_by_item(df: DataFrame, n: int = 15) -> DataFrame:
    """(item, discount_pct, margin_pct, revenue): items by how far they sell below MRP; rows above MRP are left out."""
    fine = derived(df).filter((F.col("mrp") > 0) & (F.col("selling_price") <= F.col("mrp")))
    given, listed = exact_sum((F.col("mrp") - F.col("selling_price")) * F.col("quantity")), exact_sum(F.col("mrp") * F.col("quantity"))
    sums = fine.groupBy("item").agg(given.alias("given"), listed.alias("listed"), exact_sum(F.col("row_revenue")).alias("revenue"), exact_sum(F.col("row_profit")).alias("profit"))
    return sums.select("item", percent(F.col("given"), F.col("listed")).alias("discount_pct"), percent(F.col("profit"), F.col("revenue")).alias("margin_pct"), "revenue").orderBy(F.desc("discount_pct"), "item").limit(n)


def reconciliation(s: Slice) -> DataFrame:
    """One row of differences: KPI less P&L, categories and days. All are 0 for any slice."""
    d = derived(s.current)
    kpi_ = d.agg(exact_sum(F.col("row_revenue")).alias("kpi"))
    pnl = profit_and_loss(s.current).filter("line in ('Net Revenue', 'Gross Revenue')").agg(F.max("amount").alias("pnl"))
    cats = category_ledger(s.current).agg(exact_sum(F.col("revenue")).alias("categories"))
    days = daily(s.current).agg(exact_sum(F.col("revenue")).alias("days"))
    diff = lambda c: (F.coalesce(F.col("kpi"), F.lit(0.0)) - F.coalesce(F.col(c), F.lit(0.0))).cast("decimal(20,2)").cast("double")
    return kpi_.crossJoin(pnl).crossJoin(cats).crossJoin(days).select(diff("pnl").alias("kpi_less_pnl"), diff("categories").alias("kpi_less_categories"), diff("days").alias("kpi_less_days"))  # one row each


def error_counts(errors: DataFrame) -> DataFrame:
    """(column, n) of an error table."""
    return errors.groupBy("column").agg(F.count(F.lit(1)).alias("n"))


def share_of(x: Column) -> Column:
    return percent(x, F.sum(x).over(Window.partitionBy()))

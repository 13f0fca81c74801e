"""Row-level revenue, cost and profit, and what a slice can answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fields import MEASURES, QueryError
from ..functions.numbers import floored


def derived(df: DataFrame) -> DataFrame:
    """The register with row_revenue, row_discount, row_cost, row_profit and row_tax.

    Which formula holds is decided by the columns that are there, when the plan is built:
    gross is quantity * selling price, or the line total where those are missing; a discount column reduces it; without
    one, MRP above the selling price counts as discount given but leaves revenue alone. Cost and profit need quantity and cost price.
    """
    has = set(df.columns)
    c = F.col
    if {"quantity", "selling_price"} <= has:
        gross = c("quantity") * c("selling_price")
        gross = F.coalesce(gross, c("line_total")) if "line_total" in has else gross
    elif "line_total" in has:
        gross = c("line_total")
    else:
        raise QueryError("a register needs quantity and selling price, or line total")
    null = F.lit(None).cast("double")
    discount = F.lit(0.0)
    revenue = gross
    if "discount" in has:
        discount = F.coalesce(c("discount"), F.lit(0.0))
        revenue = floored(gross - discount)
    elif {"mrp", "quantity", "selling_price"} <= has:
        given = (c("mrp") - c("selling_price")) * c("quantity")
        discount = F.when((c("mrp") > 0) & (c("mrp") >= c("selling_price")), F.greatest(given, F.lit(0.0))).otherwise(F.lit(0.0))
    cost = c("quantity") * c("cost_price") if {"quantity", "cost_price"} <= has else null
    tax = F.coalesce(c("tax"), F.lit(0.0)) if "tax" in has else F.lit(0.0)
    return df.select("*", revenue.alias("row_revenue"), discount.alias("row_discount"), cost.alias("row_cost"), (revenue - cost).alias("row_profit"), tax.alias("row_tax"))


def completeness(df: DataFrame) -> DataFrame:
    """One row: rows, and for each measure column how many of its values are blank. One pass."""
    columns = [x for x in ("quantity", "selling_price", "cost_price", "line_total", "discount", "tax", "stock_on_hand", "mrp") if x in df.columns]
    return df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(x).isNull()).alias(f"blank_{x}") for x in columns])


def unavailable_reason(blanks: dict, measure: str) -> str | None:
    """Why a slice can't answer a measure; blanks: a row of completeness() as dict."""
    if measure not in MEASURES:
        return f"There is no measure {measure}."
    needs = MEASURES[measure][1]
    if measure == "discount" and "blank_discount" not in blanks:
        needs = ["mrp", "selling_price", "quantity"]
        if any(f"blank_{x}" not in blanks for x in needs):
            return "Discount needs a discount column, or MRP, selling price and quantity."
    for x in needs:
        if f"blank_{x}" not in blanks:
            return f"{measure} needs {x}."
        if blanks["n_rows"] and blanks[f"blank_{x}"]:
            return f"{measure} is unavailable: some rows have no {x}."
    return None


def available(df: DataFrame, column: str) -> Column:
    """As an aggregate: the column is there and has no blanks."""
    return F.every(F.col(column).isNotNull()) if column in df.columns else F.lit(False)

"""From dirty cells to the canonical register, with a table of what was wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fields import BY_LABEL, FIELDS, QueryError
from ..functions import text
from ..functions.numbers import floored

NUMERIC = [n for n, (_, kind, _) in FIELDS.items() if kind == "double"]
TEXTS = [n for n, (_, kind, _) in FIELDS.items() if kind == "string"]
ERROR = "row long, column string, error string"


def mapped(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Columns renamed to canonical fields (by label or name); the first of two with one target stays, others are dropped."""
    seen: set[str] = set()
    columns = []
    for c in df.columns:
        target = BY_LABEL.get(mapping.get(c, ""), mapping.get(c, c))
        if target not in seen:
            seen.add(target)
            columns.append(F.col(f"`{c}`").alias(target))
    return df.select(*columns)


def missing_columns(columns: list[str]) -> list[str]:
    """What a register lacks: a date, and a line total or both quantity and selling price."""
    out = [] if "sale_date" in columns else ["Date"]
    if "line_total" not in columns and not {"quantity", "selling_price"} <= set(columns):
        out.append("Line Total, or Quantity and Selling Price")
    return out


def coerced(df: DataFrame) -> DataFrame:
    """Typed columns beside their cells: <column> and raw_<column>. A missing selling price is line total over quantity.

    The typed columns come out of one generated row, so what is filtered or reported afterwards refers to them and no cell is
    parsed twice.
    """
    has = df.columns
    kinds = {c: text.timestamp if c == "sale_date" else text.number for c in ["sale_date", *NUMERIC] if c in has}
    typed = F.inline(F.array(F.struct(*[f(F.col(c).cast("string")).alias(f"typed_{c}") for c, f in kinds.items()])))
    out = df.select(*[F.col(f"`{c}`").alias(f"raw_{c}") if c in kinds else F.col(f"`{c}`") for c in has], typed)
    out = out.select(*[F.col(f"`typed_{c}`").alias(c) if c in kinds else F.col(f"`{c}`") for c in has], *[f"raw_{c}" for c in kinds])
    if "selling_price" not in has and {"line_total", "quantity"} <= set(has):
        out = out.withColumn("selling_price", F.when(F.col("quantity") > 0, F.try_divide("line_total", "quantity")))
    return out


def valid(df: DataFrame) -> Column:
    """A row needs its date, and a line total or both quantity and selling price."""
    both = F.col("quantity").isNotNull() & F.col("selling_price").isNotNull() if {"quantity", "selling_price"} <= set(df.columns) else F.lit(False)
    total = F.col("line_total").isNotNull() if "line_total" in df.columns else F.lit(False)
    return F.col("sale_date").isNotNull() & (both | total)


def _problems(df: DataFrame) -> list[Column]:
    out = []

    def problem(when: Column, column: str, message: Column) -> None:
        out.append(F.when(when, F.struct(F.lit(FIELDS[column][0]).alias("column"), message.alias("error"))))

    for c in ["sale_date", *[x for x in NUMERIC if x in df.columns]]:
        if f"raw_{c}" not in df.columns:
            continue
        raw = F.trim(F.col(f"raw_{c}").cast("string"))
        blank = raw.isNull() | (raw == "")
        kept = valid(df)
        label = FIELDS[c][0]
        if c == "sale_date" or ("line_total" not in df.columns and c in ("quantity", "selling_price")):
            problem(blank, c, F.lit(f"Missing {label}"))
        problem(~blank & F.col(c).isNull(), c, F.concat(F.when(kept & F.lit(c != "sale_date"), F.lit(f"Ignored {label}: ")).otherwise(F.lit(f"Invalid {label}: ")), F.substring(raw, 1, 80)))
        if c == "quantity":
            problem(F.col(c).isNotNull() & (F.col(c) != F.round(c)), c, F.concat(F.lit("Quantity is no whole number: "), F.substring(raw, 1, 80)))
    return out


def row_errors(typed: DataFrame) -> DataFrame:
    """(row, column, error) of a coerced table with row_id."""
    listed = F.filter(F.array(*_problems(typed)), lambda x: x.isNotNull())
    return typed.select(F.col("row_id").alias("row"), F.explode(listed).alias("e")).select("row", "e.column", "e.error")


def _broken(df: DataFrame) -> list[tuple[Column, str, str]]:
    rules = [("quantity", F.col("quantity") <= 0, "Quantity must be above 0"), ("selling_price", F.col("selling_price") < 0, "Selling Price must not be negative"), ("cost_price", F.col("cost_price") < 0, "Cost Price must not be negative")]
    return [(F.coalesce(when, F.lit(False)), c, message) for c, when, message in rules if c in df.columns]


def business_errors(typed: DataFrame) -> DataFrame:
    """(row, column, error) of otherwise valid rows that break a rule."""
    listed = F.filter(F.array(*[F.when(when, F.struct(F.lit(FIELDS[c][0]).alias("column"), F.lit(m).alias("error"))) for when, c, m in _broken(typed)]), lambda x: x.isNotNull())
    return typed.filter(valid(typed)).select(F.col("row_id").alias("row"), F.explode(listed).alias("e")).select("row", "e.column", "e.error")


def normalised(df: DataFrame, mapping: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Cells with row_id -> (register, errors).

    Order matters: prices are derived and cells typed, errors found on all rows, invalid rows dropped, then blanks filled and
    floors set, then rows that break a rule dropped. Without the needed columns the register is empty and row 0 says so.
    """
    named = mapped(df, mapping)
    lacks = missing_columns(named.columns)
    spark = df.sparkSession
    if lacks:
        return spark.createDataFrame([], "row_id long"), spark.createDataFrame([(0, c, f"Missing column: {c}") for c in lacks], ERROR)
    if "row_id" not in named.columns:
        raise QueryError("cells need a row_id")
    typed = coerced(named)
    errors = row_errors(typed).unionByName(business_errors(typed))
    good = typed.filter(valid(typed))
    for when, _, _ in _broken(typed):
        good = good.filter(~when)
    fills = {c: F.coalesce(floored(F.col(c)), F.lit(0.0)) for c in ("discount", "tax", "line_total") if c in good.columns}
    fills |= {"mrp": floored(F.col("mrp"))} if "mrp" in good.columns else {}
    columns = []
    for c in good.columns:
        if c.startswith("raw_"):
            continue
        x = fills.get(c, F.col(c))
        if c in TEXTS:
            x = text.named(F.col(c).cast("string"))
            x = text.masked(x) if c == "customer" else x
        columns.append(x.alias(c))
    return good.select(*columns), errors


def whole_quantities(df: DataFrame) -> DataFrame:
    """One row: whether all quantities are whole numbers."""
    return df.agg(F.coalesce(F.every(F.col("quantity") == F.round("quantity")), F.lit(True)).alias("is_whole"))

"""What the values of a column say about its meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

# Tax slabs, in percent and as fractions.
SLABS = [0.0, 5.0, 12.0, 18.0, 28.0, 0.05, 0.12, 0.18, 0.28]
MATCH, TOLERANCE, REPEAT, SLAB_SHARE, SLAB_MOST, LEAST_ROWS, LEAST_INVOICES = 0.90, 0.01, 0.90, 0.90, 6, 5, 2
NUMERIC_SHARE = 0.80
# Texts that stand for a missing invoice number.
NO_INVOICE = ["", "nan", "none", "null", "n/a", "na", "<na>"]
#: Types whose values are counted as they are: different values have different texts, zeros of floating types aside.
TYPED = (T.IntegralType, T.DoubleType, T.FloatType, T.BooleanType, T.DateType, T.TimestampNTZType)


def product_match(df: DataFrame, total: Column, quantity: str = "quantity", price: str = "selling_price") -> DataFrame:
    """One row: rows compared and the share of them where quantity * price is the total, within 1 %."""
    q, p = F.col(quantity), F.col(price)
    rows = df.filter((q > 0) & (p > 0) & total.isNotNull())
    near = F.abs(q * p - total) <= F.greatest(F.abs(total) * TOLERANCE, F.lit(0.01))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(near.cast("double")).alias("share")).withColumn("matches", (F.col("n") >= LEAST_ROWS) & (F.col("share") >= MATCH))


def invoice_of(x: Column) -> Column:
    """An invoice number, trimmed; null where a text stands for none."""
    t = F.trim(x.cast("string"))
    return F.when(~F.lower(t).isin(NO_INVOICE), t)


def repeat_groups(cells: DataFrame, *keys: str) -> DataFrame:
    """(keys, inv, cell, num) -> (keys, n, share): invoices of several rows and the share of them on which the value is the same.

    Values are compared as numbers where at least NUMERIC_SHARE of all cells are numbers (so 1200 and a cell with a currency sign
    and commas agree, and other cells drop out), else as texts. Rows without an invoice number or a value take no part. The rows
    of an invoice meet as a count, a least and a greatest value, so no invoice is too large.
    """
    per = cells.groupBy(*keys, "inv").agg(
        F.count(F.lit(1)).alias("rows"), F.count("num").alias("k_num"), (F.min("num") == F.max("num")).alias("same_num"), F.count("cell").alias("k_txt"), (F.min("cell") == F.max("cell")).alias("same_txt"),
    )
    seen = lambda k: F.col("inv").isNotNull() & (F.col(f"k_{k}") >= 2)
    sums = per.groupBy(*keys).agg(
        (F.sum("k_num") / F.sum("rows") >= NUMERIC_SHARE).alias("numeric"), *[F.count_if(seen(k)).alias(f"n_{k}") for k in ("num", "txt")], *[F.avg(F.when(seen(k), F.col(f"same_{k}").cast("double"))).alias(f"share_{k}") for k in ("num", "txt")],
    )
    pick = lambda c: F.when(F.col("numeric"), F.col(f"{c}_num")).otherwise(F.col(f"{c}_txt"))
    return sums.select(*keys, F.coalesce(pick("n"), F.lit(0)).alias("n"), pick("share").alias("share"))


def invoice_repeat(df: DataFrame, value: str, invoice: str = "invoice_no") -> DataFrame:
    """One row: invoices of several rows, and the share of them on which the value is the same: then it belongs to the invoice. See repeat_groups()."""
    cell = F.col(f"`{value}`").cast("string")
    cells = df.select(invoice_of(F.col(f"`{invoice}`")).alias("inv"), cell.alias("cell"), text.number_of(df, value).alias("num"))
    return repeat_groups(cells).withColumn("repeats", F.coalesce((F.col("n") >= LEAST_INVOICES) & (F.col("share") >= REPEAT), F.lit(False)))


def slab_coverage(df: DataFrame, value: Column) -> DataFrame:
    """One row: distinct values and the share that are tax rates."""
    rows = df.select(value.alias("v")).filter("v is not null")
    return rows.agg(F.count_distinct("v").alias("n_distinct"), F.avg(F.col("v").isin(SLABS).cast("double")).alias("share")).withColumn("is_rate", (F.col("n_distinct") <= SLAB_MOST) & (F.col("share") >= SLAB_SHARE))


def _chosen(i: Column, choices: list[tuple[int, Column]]) -> Column:
    """The choice of number i, found by halves, so that wide tables don't try all; null where there is none."""
    if len(choices) == 1:
        return F.when(i == choices[0][0], choices[0][1])
    half = len(choices) // 2
    return F.when(i < choices[half][0], _chosen(i, choices[:half])).otherwise(_chosen(i, choices[half:]))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, t, k): the trimmed text of each different value and its number of rows, in one pass.

    Rows are counted by the values as they are, in one slot for each type, and only different values become texts. Zeros of floating types go as texts,
    as 0.0 and -0.0 are one value and two texts. What a row is multiplied by is a fixed array of numbers, so no array is built for a row.
    """
    slots: dict[str, list[tuple[int, Column]]] = {}
    for i, c in enumerate(columns):
        x, kind = F.col(f"c{i}"), df.schema[c].dataType
        own = {kind.simpleString(): x} if isinstance(kind, TYPED) else {"string": F.trim(x.cast("string"))}
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            own = {kind.simpleString(): F.when(x != 0, x), "string": F.when(x == 0, x.cast("string"))}
        for slot, value in own.items():
            slots.setdefault(slot, []).append((i, value))
    cells = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], F.explode(F.lit(list(range(len(columns))))).alias("i"))
    values = cells.select("i", *[_chosen(F.col("i"), x).alias(f"v_{slot}") for slot, x in slots.items()]).groupBy("i", *[f"v_{slot}" for slot in slots]).agg(F.count(F.lit(1)).alias("k"))
    text_of = F.coalesce(*[F.col(f"v_{slot}").cast("string") for slot in slots])
    return values.select(F.get(F.lit(columns), F.col("i")).alias("column"), text_of.alias("t"), "k")


def shape(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, null_ratio, numeric_ratio, date_ratio, unique_ratio, mean_length, all_integer) of text columns, in one pass. A value is read once, however many rows have it."""
    values = value_counts(df, columns)
    some = F.col("t").isNotNull() & (F.col("t") != "")
    read = values.withColumn("some", F.coalesce(some, F.lit(False))).withColumn("num", F.when(F.col("some"), text.number(F.col("t"))))
    read = read.withColumn("date", F.when(F.col("some") & F.col("num").isNull(), text.timestamp(F.col("t"))))
    rows = lambda when: F.coalesce(F.sum(F.when(when, F.col("k"))), F.lit(0))
    n = rows(F.col("some"))
    share = lambda of: F.coalesce(F.try_divide(of, n), F.lit(0.0))
    whole = F.col("num").isNotNull() & (F.col("num") == F.round("num"))
    shapes = read.groupBy("column").agg(
        (rows(~F.col("some")) / F.sum("k")).alias("null_ratio"), share(rows(F.col("num").isNotNull())).alias("numeric_ratio"), share(rows(F.col("date").isNotNull())).alias("date_ratio"), share(F.count_if("some")).alias("unique_ratio"),
        F.try_divide(F.sum(F.when(F.col("some"), F.length("t") * F.col("k"))), n).alias("mean_length"), F.coalesce(F.every(F.when(F.col("some"), whole)), F.lit(False)).alias("all_integer"),
    )
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")  # tables without rows have a shape too
    none = {"numeric_ratio": F.lit(0.0), "date_ratio": F.lit(0.0), "unique_ratio": F.lit(0.0), "all_integer": F.lit(False)}
    return names.join(F.broadcast(shapes), "column", "left").withColumns({c: F.coalesce(c, x) for c, x in none.items()})

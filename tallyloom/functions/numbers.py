"""Sums that don't depend on order, guarded divisions, and numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(20,6)"


def exact_sum(x: Column) -> Column:
    """Sum in decimals of six places, as double: the same whatever order rows come in."""
    return F.sum(x.cast(MONEY)).cast("double")


def div(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or either is null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def percent(a: Column, b: Column) -> Column:
    return div(a, b) * 100


def finite(x: Column) -> Column:
    """Null for NaN (which is above all numbers) and infinities. x is taken once, as an array's one value."""
    return F.get(F.transform(F.array(x), lambda v: F.when(F.abs(v) < float("inf"), v)), F.lit(0))


def floored(x: Column) -> Column:
    """At least 0; null stays null."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def indian_grouping(x: Column) -> Column:
    """Whole part with the last three digits apart and pairs before them: 1234567 -> 12,34,567."""
    whole = F.abs(F.round(x)).cast("decimal(20,0)").cast("string")
    grouped = F.regexp_replace(whole, r"(?<=\d)(?=(\d\d)+\d$)", ",")
    return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), grouped)


def compact_money(x: Column) -> Column:
    """Crores and lakhs with two places, thousands with one, less as whole numbers."""
    a = F.abs(x)
    return F.when(a >= 1e7, F.format_string("%.2fCr", x / 1e7)).when(a >= 1e5, F.format_string("%.2fL", x / 1e5)).when(a >= 1e3, F.format_string("%.1fK", x / 1e3)).otherwise(F.format_string("%.0f", x))


def shortened(x: Column, n: int = 18) -> Column:
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n - 1), F.lit("…"))).otherwise(x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; null where either has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.try_divide(dot, norm(a) * norm(b))


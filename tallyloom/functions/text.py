"""Text expressions: coercion of dirty cells, masking, slugs, header tokens."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fields import UNSPECIFIED
from .numbers import finite

# Date patterns of exports: ISO, with names of months, and by the mark between numbers.
ISO_FORMATS = ["yyyy-M-d", "yyyy-M-d H:m:s", "yyyy-M-d H:m", "yyyy-M-d'T'H:m:s"]
NAMED_FORMATS = ["d MMM yyyy", "d-MMM-yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d-MMM-yy"]
MARKED_FORMATS = {
    "/": ["d/M/yyyy", "d/M/yyyy H:m", "d/M/yyyy H:m:s", "d/M/yy", "yyyy/M/d"],
    ".": ["d.M.yyyy"],
    "-": ["d-M-yyyy", "d-M-yyyy H:m", "d-M-yyyy H:m:s", "d-M-yy"],
}
PLAIN_FORMATS = ["yyyyMMdd"]


def number(x: Column) -> Column:
    """A number from a cell, without currency signs, commas and spaces; else null. Never NaN or infinite. Cells without a digit aren't tried, as a try that fails is dear; cells of digits alone have no signs to lose."""
    bare = F.when(x.rlike(r"^[0-9]+$"), x).when(x.rlike("[0-9]"), F.regexp_replace(x, r"[₹$€£,\s]", ""))
    return finite(bare.try_cast("double"))


def number_of(df: DataFrame, column: str) -> Column:
    """number() of a column's cells; whole numbers and doubles are their own, without a text between."""
    x = F.col(f"`{column}`")
    if df.schema[column].dataType.typeName() in ("double", "long", "integer", "short", "byte"):
        return F.when(F.abs(x.cast("double")) < float("inf"), x.cast("double"))
    return number(x.cast("string"))


def timestamp(x: Column) -> Column:
    """A date from a cell: ISO if it looks like it, else day first, else by month name; null if none fits.

    A cell meets only the patterns of its kind, and none without a digit: a pattern that fails is dear. The choice is a lambda over an array of the one
    cell, so it stands once in a plan, however often the date is used, and stays out of the generated code of its stage.
    """
    tries = lambda t, formats: F.coalesce(*[F.try_to_timestamp(t, F.lit(f)).cast("timestamp_ntz") for f in formats])

    def parsed(t: Column) -> Column:
        out = F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), tries(t, ISO_FORMATS)).when(t.rlike("[A-Za-z]"), tries(t, NAMED_FORMATS))
        for mark, formats in MARKED_FORMATS.items():
            out = out.when(F.contains(t, F.lit(mark)), tries(t, formats))
        return F.when(t.rlike("[0-9]"), out.otherwise(tries(t, PLAIN_FORMATS)))

    return F.get(F.transform(F.array(F.trim(x)), parsed), F.lit(0))


# Words for currencies, names of months, and the shapes of a date.
CURRENCY_WORDS = r"(?i)\b(?:rs|inr|rupees?|usd|eur|gbp)\b\.?\s*"
MONTH_WORDS = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t)?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
DATE_SHAPES = [
    r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}", r"\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}", rf"\d{{1,2}}\s*[-/.]?\s*{MONTH_WORDS}\w*\s*[-/.]?\s*\d{{2,4}}", rf"{MONTH_WORDS}\w*\s*[-/.]?\s*\d{{1,2}},?\s*\d{{2,4}}", r"\d{8}",
]


def number_like(x: Column) -> Column:
    """Whether a cell is a number once currency words and signs, commas, percent signs and spaces are gone; false for null."""
    bare = F.regexp_replace(F.regexp_replace(x, CURRENCY_WORDS, ""), r"[₹$€£,\s%]", "")
    return F.coalesce(bare.try_cast("double").isNotNull(), F.lit(False))


def date_like(x: Column) -> Column:
    """Whether a cell has the shape of a date, whatever its numbers; false for null."""
    return F.coalesce(x.rlike(r"(?i)^\s*(?:" + "|".join(DATE_SHAPES) + r")\s*$"), F.lit(False))


def named(x: Column) -> Column:
    """Trimmed text; blanks and the names of nothing become Unspecified."""
    t = F.trim(x)
    return F.when(t.isNull() | t.isin("", "nan", "None", "NaT"), UNSPECIFIED).otherwise(t)


# What is hidden in samples, and what stands for it.
MASKS = [
    (r"[\w.+-]+@[\w-]+\.[\w.-]+", "[email]"),
    (r"(?<![\d.])(?:\+?91[\s-]?)?[6-9]\d{4}[\s-]?\d{5}(?![\d.])", "[phone]"),
    (r"(?<!\d)\d{9,}(?!\d)", "[number]"),
]


def masked(x: Column, most: int = 60) -> Column:
    """Mail addresses, phone numbers and runs of nine digits or more hidden, then cut."""
    for pattern, shown in MASKS:
        x = F.regexp_replace(x, pattern, shown)
    return F.substring(x, 1, most)


def redacted(x: Column) -> Column:
    return F.when(F.trim(x) != "", "[redacted]").otherwise("")


#: The steps of a slug: patterns and what stands for them.
SLUG = [("%", "_pct_"), ("[^a-z0-9]+", "_")]


def slug(x: Column) -> Column:
    """Lower case; % becomes pct, all but letters and digits an underscore."""
    t = F.lower(F.trim(x))
    for pattern, by in SLUG:
        t = F.regexp_replace(t, pattern, by)
    return F.trim(t, F.lit("_"))


def tokens(x: Column) -> Column:
    return F.filter(F.split(F.lower(F.trim(x)), "[^a-z0-9]+"), lambda t: t != "")


def header_key(x: Column) -> Column:
    return F.lower(F.ltrim(F.trim(x), F.lit("\ufeff")))


def normalised(x: Column, form: str = "NFKC") -> Column:
    """A Unicode normal form, which Spark has no expression for: an Arrow batch at a time, and ASCII stays in the JVM."""
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v if v is None else unicodedata.normalize(form, v))

    return F.when(x.rlike(r"^\p{ASCII}*$"), x).otherwise(run(x))


def sanitised(x: Column, most: int = 200) -> Column:
    """A note in its compatible form on one line: no control characters, one space between words, cut."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(normalised(x), r"[\p{Cc}\p{Cf}]", " "), r"\s+", " ")), 1, most)


def digest(x: Column) -> Column:
    """The key that stands for a customer or a template: a SHA-256 in hexadecimal."""
    return F.sha2(x, 256)


def percent_text(x: Column) -> Column:
    """A percentage in a sentence, without its sign; what can't be measured is said so."""
    return F.when(x.isNull(), "an unmeasurable amount").otherwise(F.format_string("%.1f%%", F.abs(x)))


def day_text(x: Column) -> Column:
    return F.date_format(x, "d MMM")


def claimed_numbers(x: Column) -> Column:
    """The numbers that a text claims, with lakh and crore scaled; commas are grouping."""
    found = F.regexp_extract_all(F.lower(x), F.lit(r"(\d[\d,]*(?:\.\d+)?\s*(?:lakhs?|crores?|cr|l|k|%)?)"), 1)

    def value(t: Column) -> Column:
        n = F.regexp_replace(F.regexp_extract(t, r"^([\d,]*(?:\.\d+)?)", 1), ",", "").try_cast("double")
        unit = F.regexp_extract(t, r"(lakh|crore|cr|l|k)s?\s*$", 1)
        return n * F.when(unit.isin("lakh", "l"), 1e5).when(unit.isin("crore", "cr"), 1e7).when(unit == "k", 1e3).otherwise(1.0)

    return F.transform(found, value)


def supported(claim: Column, known: Column) -> Column:
    """A claimed number is near one of the known: within 0.5, or half a percent."""
    return F.exists(known, lambda k: F.abs(k - claim) <= F.greatest(F.lit(0.5), 0.005 * F.abs(k)))

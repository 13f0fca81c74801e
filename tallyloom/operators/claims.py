"""Whether the numbers that a text claims are among those that were measured.

A scanner finds the numbers and what stands beside them, in the JVM: dates, years on their own and small ranks need no proof,
amounts, percentages and counts do. Claims meet facts by a join on intervals of the value. An interval is as wide as the
tolerance, so a fact is in three intervals at most and no claim is held against all facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words beside a number that tell what it is.
MONTHS = ["jan", "january", "feb", "february", "mar", "march", "apr", "april", "may", "jun", "june", "jul", "july", "aug", "august", "sep", "sept", "september", "oct", "october", "nov", "november", "dec", "december"]
UNITS = ["units", "unit", "pieces", "piece", "items", "item", "orders", "bills", "days", "hours", "minutes", "weeks", "months", "years", "times", "people", "customers", "packs", "boxes", "dozen", "kg", "grams"]
RANKS = ["top", "bottom", "first", "last", "best", "worst", "highest", "lowest", "next", "leading", "biggest", "largest", "smallest"]
ORDINALS = ["st", "nd", "rd", "th"]
# Phrases that call a day the best or the worst, and how near a day's name has to stand.
BEST_PHRASES = ["strongest", "busiest", "best day", "highest takings", "top day", "most sales"]
WORST_PHRASES = ["weakest", "slowest", "worst day", "lowest takings", "least takings", "least sales"]
NEAR = 45
# The greatest rank, the years, the tolerances, the scales.
MOST_RANK, YEARS, WITHIN, SHARE = 10, (1900, 2099), 0.5, 0.005
SCALES = {"crore": 1e7, "lakh": 1e5}
DATE = r"[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}|[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4}"
TOKEN = rf"(?i)(?:{DATE}|[₹$]?(?:rs\.?\s?)?[0-9][0-9,]*(?:\.[0-9]+)?\s*(?:lakh|crore)?)"
#: Growth from one interval of values to the next, beyond 100; below, an interval is 1 wide.
STEP = 1.01


def token_value(token: Column) -> Column:
    """The number of a token, with its scale; commas are grouping."""
    low = F.lower(token)
    plain = F.regexp_replace(F.regexp_extract(low, r"[0-9][0-9,]*(?:\.[0-9]+)?", 0), ",", "").try_cast("double")
    scale = F.lit(1.0)
    for word, by in reversed(SCALES.items()):
        scale = F.when(low.rlike(rf"\b{word}"), by).otherwise(scale)
    return plain * scale


def scanned(texts: DataFrame, text: str = "text") -> DataFrame:
    """+ position, token, value, before, after, kind of each number in a text: date, year, rank or claim. Texts without numbers, and null ones, give no row.

    `before` and `after` are the words (a to z) that touch the number.
    """
    t = F.col(f"`{text}`")
    both = F.arrays_zip(F.regexp_extract_all(t, F.lit(TOKEN), 0).alias("token"), F.slice(F.split(t, TOKEN, -1), 1, 2**31 - 1).alias("left"), F.slice(F.split(t, TOKEN, -1), 2, 2**31 - 1).alias("right"))
    own = [F.col(f"`{c}`") for c in texts.columns if c not in ("position", "token", "value", "before", "after", "kind")]
    rows = texts.select(*own, F.posexplode(both).alias("position", "x")).filter("x.token is not null and x.token <> ''")
    token = F.trim(F.regexp_replace("x.token", r"\s+", " "))
    rows = rows.withColumns({
        "value": token_value(F.col("x.token")), "token": token,
        "before": F.regexp_extract(F.lower("x.left"), r"([a-z]+)\s*$", 1), "after": F.regexp_extract(F.lower("x.right"), r"^\s*([a-z]+)", 1),
    })
    bare = F.rtrim(F.col("token"), F.lit(",.; "))
    date = F.col("token").rlike(f"^(?:{DATE})$") | F.col("before").isin(MONTHS) | F.col("after").isin(MONTHS)
    year = bare.rlike("^[0-9]+$") & ~F.col("after").isin(UNITS) & F.col("value").between(*YEARS)
    small = (F.col("value") == F.floor("value")) & F.col("value").between(1, MOST_RANK)
    rank = F.col("after").isin(ORDINALS) | (small & (F.col("before").isin(RANKS) | F.col("after").isin(RANKS)))
    return rows.withColumn("kind", F.when(date, "date").when(year, "year").when(rank, "rank").otherwise("claim")).drop("x")


def interval(x: Column) -> Column:
    """The interval of a value from 0 on; greater values never lie in a lesser one."""
    return F.when(x <= 100, F.floor(x)).otherwise(100 + F.floor(F.log(x / 100) / F.log(F.lit(STEP)))).cast("long")


def unsupported(claims: DataFrame, facts: DataFrame, *scope: str) -> DataFrame:
    """The claims (rows with a value) that no fact (scope, value) is near: within WITHIN, or SHARE of the fact."""
    t = F.greatest(F.lit(WITHIN), SHARE * F.abs("value"))
    f = facts.filter("value is not null and not isnan(value)").select(*scope, F.col("value").alias("fact"), (F.col("value") + t).alias("most"), F.greatest(F.col("value") - t, F.lit(0.0)).alias("least")).filter("most >= 0")
    f = f.select(*[F.col(s).alias(f"f_{s}") for s in scope], "fact", F.explode(F.sequence(interval(F.col("least")), interval(F.col("most")))).alias("f_interval")).distinct()
    c = claims.withColumn("interval", interval(F.col("value")))
    close = F.abs(F.col("value") - F.col("fact")) <= F.greatest(F.lit(WITHIN), SHARE * F.abs("fact"))
    return c.join(f, [F.col("interval") == F.col("f_interval"), *[c[s].eqNullSafe(f[f"f_{s}"]) for s in scope], close], "left_anti").drop("interval")


def checked(texts: DataFrame, facts: DataFrame, *scope: str, text: str = "text") -> DataFrame:
    """The numbers in texts that need proof and have none: scanned() rows without `kind`."""
    return unsupported(scanned(texts, text).filter("kind = 'claim'").drop("kind"), facts, *scope)


def inverted_weekdays(text: Column, best: Column, worst: Column) -> Column:
    """Phrases that a text puts beside the wrong one of two days: [strongest] where the worst day, and not the best, is near it."""
    low = F.lower(text)
    names = lambda d: (F.lower(F.trim(d)), F.substring(F.lower(F.trim(d)), 1, 3))

    def beside(phrase: str, wrong: Column, right: Column) -> Column:
        at = F.locate(phrase, low) - 1
        first = F.greatest(at - NEAR, F.lit(0))
        around = F.substring(low, first + 1, at + len(phrase) + NEAR - first)
        has = lambda d: F.contains(around, names(d)[0]) | F.contains(around, names(d)[1])
        return F.when((at >= 0) & has(wrong) & ~has(right), phrase)

    known = (F.coalesce(F.trim(best), F.lit("")) != "") & (F.coalesce(F.trim(worst), F.lit("")) != "")
    found = F.array_compact(F.array(*[beside(p, worst, best) for p in BEST_PHRASES], *[beside(p, best, worst) for p in WORST_PHRASES]))
    return F.when(known, found).otherwise(F.array().cast("array<string>"))

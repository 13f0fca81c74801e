"""Columns that map to no canonical field: what they are and how they may be used; and what a register can answer."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fields import DIMENSIONS, MEASURES
from ..functions import text
from .derive import completeness, unavailable_reason
from .evidence import shape

MOST_EXTRAS = 30
# Terms of headers.
PERSONAL_TERMS = ["phone", "mobile", "email", "contact", "aadhaar", "ssn", "pan", "address", "customer", "client", "recipient", "patient", "dob", "birth", "personal", "account holder", "taxpayer"]
PRODUCT_TERMS = ["product", "item", "brand", "style", "model", "design", "sku"]
ID_TOKENS = ["id", "no", "number", "code", "ref"]
RATE_TERMS = ["%", "pct", "percent", "rate", "ratio", "margin"]
NOTE_TERMS = ["note", "remark", "comment", "description", "narration"]


def slugs(headers: list[str]) -> dict[str, str]:
    """A name of lower-case letters, digits and underscores, as text.slug() makes it, for each of the first MOST_EXTRAS headers; later ones of a name get _2, _3."""
    out: dict[str, str] = {}
    used: dict[str, int] = {}
    for h in headers[:MOST_EXTRAS]:
        s = h.strip(" ").lower()
        for pattern, by in text.SLUG:
            s = re.sub(pattern, by, s)
        s = s.strip("_") or "col"
        used[s] = used.get(s, 0) + 1
        out[h] = s if used[s] == 1 else f"{s}_{used[s]}"
    return out


def classified(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """{column: {name, role, aggregation, reason}} of up to MOST_EXTRAS columns: personal, date-like, id-like, measure, dimension or stored.

    One pass measures the shape of all of them; a row for each column comes to the driver.
    """
    columns = columns[:MOST_EXTRAS]
    if not columns:
        return {}
    stats = {r["column"]: r for r in shape(df, columns).collect()}
    hits = df.agg(*[F.coalesce(F.avg(F.col(f"`{c}`").cast("string").rlike(r"[\w.+-]+@[\w-]+(\.[\w-]+)+|(?<!\d)\d{9,}(?!\d)").cast("double")), F.lit(0.0)).alias(c) for c in columns], *[F.count_distinct(F.col(f"`{c}`")).alias(f"n {c}") for c in columns]).first()
    names, out = slugs(columns), {}
    for c in columns:
        s, h, n = stats[c], c.strip().lower(), hits[f"n {c}"]
        tokens = "".join(x if x.isalnum() else " " for x in h).split()
        if any(t in h for t in PERSONAL_TERMS) or ("name" in tokens and not set(tokens) & set(PRODUCT_TERMS)) or hits[c] >= 0.30:
            role, how, why = "x_col", None, "personal"
        elif s["date_ratio"] >= 0.80:
            role, how, why = "x_col", None, "date-like"
        elif set(tokens) & set(ID_TOKENS) or n == 1 or (s["unique_ratio"] >= 0.90 and s["all_integer"]):
            role, how, why = "x_col", None, "id-like"
        elif s["numeric_ratio"] >= 0.80:
            role, how, why = "x_meas", "average" if any(t in h for t in RATE_TERMS) else "sum", "numeric"
        elif not any(t in h for t in NOTE_TERMS) and 1 <= n <= 50 and not (s["unique_ratio"] > 0.60 and n > 5):
            role, how, why = "x_dim", None, "few values"
        else:
            role, how, why = "x_col", None, "free text"
        out[c] = {"name": f"{role}_{names[c]}", "role": role, "aggregation": how, "reason": why}
    return out


def with_extras(df: DataFrame, registry: dict[str, dict]) -> DataFrame:
    """Extra columns under their names: numbers, text with blanks named, personal values redacted. Each column's role goes with it in the schema, through Parquet too."""
    for c, e in registry.items():
        x = F.col(f"`{c}`").cast("string")
        value = text.number(x) if e["role"] == "x_meas" else text.named(x) if e["role"] == "x_dim" else text.redacted(x) if e["reason"] == "personal" else x
        df = df.withColumn(e["name"], value).withMetadata(e["name"], {"role": e["role"], "aggregation": e["aggregation"] or "", "reason": e["reason"]}).drop(c)
    return df


def registry_of(df: DataFrame) -> DataFrame:
    """(name, role, aggregation, reason) of the extra columns of a register, as its schema has them: they were written with it."""
    rows = [(f.name, f.metadata["role"], f.metadata.get("aggregation") or None, f.metadata.get("reason")) for f in df.schema.fields if "role" in f.metadata]
    return df.sparkSession.createDataFrame(rows, "name string, role string, aggregation string, reason string")


def unmapped(headers: list[str], mapped: list[str]) -> list[str]:
    """The first MOST_EXTRAS headers that map to no field, in their order."""
    taken = set(mapped)
    return [h for h in dict.fromkeys(headers) if h not in taken][:MOST_EXTRAS]


def coverage(registry: dict[str, dict], mapped: int) -> dict[str, int]:
    """Columns by how they can be used."""
    count = lambda role: sum(e["role"] == role for e in registry.values())
    return {"mapped": mapped, "extra_measure": count("x_meas"), "extra_dimension": count("x_dim"), "stored_only": count("x_col")}


def capabilities(df: DataFrame) -> DataFrame:
    """(kind, name, available, reason): every measure and dimension, flagged, none left out. One row of null counts comes to the driver."""
    blanks = completeness(df).first().asDict()
    rows = [("measure", m, (r := unavailable_reason(blanks, m)) is None, r) for m in MEASURES]
    rows += [("dimension", d, d in df.columns, None if d in df.columns else f"There is no {d}.") for d in DIMENSIONS]
    rows += [("dimension", d, True, None) for d in ("day", "weekday", "month")]
    rows.sort(key=lambda r: (r[0], not r[2]))
    return df.sparkSession.createDataFrame(rows, "kind string, name string, available boolean, reason string")


# Cards and charts with the columns that they need, the dimension and how many different values it must have.
CARDS = {
    "revenue": [], "profit": ["cost_price", "quantity"], "margin_pct": ["cost_price", "quantity"], "units": ["quantity"], "transactions": [], "discount": ["discount"],
    "discount_pct": ["mrp", "selling_price", "quantity"], "stock_on_hand": ["stock_on_hand"], "days_of_cover": ["stock_on_hand"],
}
CHARTS = {
    "daily_trend": ([], "sale_date", 2), "revenue_by_category": (["category"], "category", 2), "top_items": (["item"], "item", 2), "revenue_by_branch": (["branch"], "branch", 2), "payment_mode_split": (["payment_mode"], "payment_mode", 2),
    "weekday_heatmap": ([], "sale_date", 14), "pnl": (["cost_price", "quantity"], None, 0), "discount_vs_margin": (["mrp", "selling_price", "cost_price", "quantity"], "item", 1),
}


def cards_and_charts(df: DataFrame) -> DataFrame:
    """(kind, name, available, reason): every card and chart, flagged. One row of counts comes to the driver."""
    dimensions = [c for c in ("sale_date", "category", "item", "branch", "payment_mode") if c in df.columns]
    n = df.agg(*[F.count_distinct(F.to_date(c) if c == "sale_date" else F.col(c)).alias(c) for c in dimensions]).first().asDict()
    blanks = completeness(df).first().asDict()

    def reason(needs: list[str], dimension: str | None = None, least: int = 0) -> str | None:
        if not blanks["n_rows"]:
            return "There are no rows."
        for x in needs:
            if x not in df.columns:
                return f"Needs {x}."
            if blanks.get(f"blank_{x}"):
                return f"Some rows have no {x}."
        if dimension and n.get(dimension, 0) < least:
            return f"Needs at least {least} different values of {dimension}."
        return None

    rows = [("card", k, (r := reason(needs)) is None, r) for k, needs in CARDS.items()] + [("chart", k, (r := reason(*needs)) is None, r) for k, needs in CHARTS.items()]
    return df.sparkSession.createDataFrame(rows, "kind string, name string, available boolean, reason string")


def share_texts(mix: DataFrame) -> DataFrame:
    """(label, share) -> (label, share_text), as they stand in a sentence."""
    return mix.select("label", text.percent_text(F.col("share")).alias("share_text"))


def masked_description(df: DataFrame, column: str, samples: int = 5) -> DataFrame:
    """One row: a column's shape and a few masked sample values, none where most values are text that isn't numeric."""
    s = shape(df.select(column), [column])
    few = df.select(text.masked(F.col(f"`{column}`").cast("string")).alias("v")).filter("v <> ''").distinct().orderBy("v").limit(samples).agg(F.sort_array(F.collect_list("v")).alias("samples"))
    return s.crossJoin(few).withColumn("samples", F.when(F.col("numeric_ratio") >= 0.5, F.col("samples")).otherwise(F.array().cast("array<string>")))  # one row each

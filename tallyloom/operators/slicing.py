"""Windows anchored to the data, membership filters, slices and filter options."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fields import DIMENSIONS, MAX_FILTER_VALUES, MAX_FILTERS, MAX_KEY, MAX_VALUE, OPTIONS, QueryError

PRESETS = {"all": None, "today": 1, "week": 7, "30days": 30, "month": None, "custom": None}
#: Longer value lists are joined instead of listed.
LONG_LIST = 1000


@dataclass(frozen=True)
class Window:
    """[start, end) and the period of the same length before it; `all` has none (previous_start = previous_end)."""

    start: date
    end: date
    previous_start: date
    previous_end: date


@dataclass(frozen=True)
class AnalysisQuery:
    time_filter: str = "all"
    start_date: date | None = None
    end_date: date | None = None
    filters: dict[str, list[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.time_filter not in PRESETS:
            raise QueryError(f"unknown time filter {self.time_filter}")
        if len(self.filters) > MAX_FILTERS:
            raise QueryError(f"at most {MAX_FILTERS} filters")
        for key, values in self.filters.items():
            if len(key) > MAX_KEY or len(values) > MAX_FILTER_VALUES or any(len(str(v)) > MAX_VALUE for v in values):
                raise QueryError(f"filter {key[:MAX_KEY]} is too large")


def date_range(df: DataFrame) -> DataFrame:
    """One row: first and last day, and the days from one to the other."""
    day = F.col("sale_date").cast("date")
    return df.agg(F.min(day).alias("min_day"), F.max(day).alias("max_day")).withColumn("span_days", F.datediff("max_day", "min_day") + 1)


def resolve_window(first: date | None, last: date | None, query: AnalysisQuery) -> Window:
    """The window of a query over data from first to last day.

    Presets end at the last day of the data. A custom range is cut to the data if they overlap, and stays as asked for (an empty
    slice) if not.
    """
    day = timedelta(days=1)
    if first is None or last is None:
        today = datetime.now().date()
        return Window(today, today, today, today)
    kind = query.time_filter
    if kind == "custom":
        start, stop = query.start_date, query.end_date
        if not start or not stop:
            raise QueryError("a custom range needs both dates")
        if start > stop:
            raise QueryError("a custom range starts on or before its end")
        if stop >= first and start <= last:
            start, stop = max(start, first), min(stop, last)
    elif kind == "all":
        return Window(first, last + day, first, first)
    else:
        start, stop = last.replace(day=1) if kind == "month" else last - (PRESETS[kind] - 1) * day, last
    span = stop + day - start
    return Window(start, stop + day, start - span, start)


def in_range(df: DataFrame, start: date, end: date) -> DataFrame:
    """Rows of [start, end): literals, so the scan gets the filter."""
    return df.filter((F.col("sale_date") >= F.lit(start).cast("timestamp_ntz")) & (F.col("sale_date") < F.lit(end).cast("timestamp_ntz")))


def role(df: DataFrame, column: str) -> str | None:
    """What an extra column was registered as: x_dim, x_meas or x_col. The register's schema says so; a name alone gives no right."""
    return next((f.metadata.get("role") for f in df.schema.fields if f.name == column), None)


def facets(df: DataFrame) -> list[str]:
    """The columns that a register can be filtered and grouped by: its dimensions, and the extras that are registered as such."""
    return [c for c in df.columns if c in DIMENSIONS or role(df, c) == "x_dim"]


def filtered(df: DataFrame, filters: dict[str, list[str]]) -> DataFrame:
    """All keys hold, for each any of its values; an empty list restricts nothing. Stored-only, personal and unknown columns are errors."""
    allowed = facets(df)
    for key, values in filters.items():
        if key not in allowed:
            raise QueryError(f"no filter on {key}")
        if not values:
            continue
        text = F.col(key).cast("string")
        if len(values) > LONG_LIST:
            listed = df.sparkSession.createDataFrame([(str(v),) for v in dict.fromkeys(values)], "v string")  # at most MAX_FILTER_VALUES rows
            df = df.join(F.broadcast(listed), text == F.col("v"), "left_semi")
        else:
            df = df.filter(text.isin([str(v) for v in values]))
    return df


@dataclass(frozen=True)
class Slice:
    current: DataFrame
    previous: DataFrame
    window: Window


def build_slice(df: DataFrame, query: AnalysisQuery, days: DataFrame | None = None) -> Slice:
    """The window is that of the whole register; filters hold in both periods. One row comes to the driver: the data's span.

    days: a frame with the same span of sale_date that is cheaper to read than df.
    """
    span = date_range(df if days is None else days).first()
    w = resolve_window(span["min_day"], span["max_day"], query)
    return Slice(filtered(in_range(df, w.start, w.end), query.filters), filtered(in_range(df, w.previous_start, w.previous_end), query.filters), w)


def dimension_options(df: DataFrame, limit: int = OPTIONS) -> DataFrame:
    """(dimension, value): the distinct values of every dimension that is there, the first `limit` of each in order. One pass."""
    from pyspark.sql import Window as W

    dims = facets(df)
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims])).alias("o")).select("o.*").distinct()
    rank = F.row_number().over(W.partitionBy("dimension").orderBy("value"))
    return stacked.withColumn("r", rank).filter(F.col("r") <= limit).drop("r")


def cascading_options(df: DataFrame, query: AnalysisQuery, dimension: str, search: str = "", limit: int = OPTIONS) -> DataFrame:
    """(value): values of one dimension under the window and all other filters, that contain `search` in any case."""
    if dimension not in facets(df):
        raise QueryError(f"no filter on {dimension}")
    others = {k: v for k, v in query.filters.items() if k != dimension}
    values = build_slice(df, AnalysisQuery(query.time_filter, query.start_date, query.end_date, others)).current.select(F.col(dimension).cast("string").alias("value"))
    if search:
        values = values.filter(F.lower("value").contains(search.lower()))
    return values.distinct().orderBy("value").limit(max(1, min(limit, MAX_FILTER_VALUES)))


def drill_down(query: AnalysisQuery, dimension: str, label: str) -> AnalysisQuery | None:
    """The query behind one point of a chart: a day or a month becomes a custom range, a value a filter; a weekday has none."""
    if dimension == "weekday":
        return None
    if dimension == "day":
        d = date.fromisoformat(label)
        return AnalysisQuery("custom", d, d, query.filters)
    if dimension == "month":
        d = date.fromisoformat(label + "-01")
        return AnalysisQuery("custom", d, (d.replace(day=28) + timedelta(days=4)).replace(day=1) - timedelta(days=1), query.filters)
    return AnalysisQuery(query.time_filter, query.start_date, query.end_date, {**query.filters, dimension: [label]})


def head_and_tail(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first and the last n rows by a unique order, each once: two top-k lists, no sort of all rows."""
    head, tail = df.orderBy(*order).limit(n), df.orderBy(*[F.desc(c) for c in order]).limit(n)
    return head.union(tail).distinct()


def selected_options(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Those of the selected values that a slice has."""
    return df.select(column).distinct().intersect(df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string"))

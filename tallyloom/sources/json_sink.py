"""Results as JSON that any reader takes: no NaN, no infinity, numbers rounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import finite


def safe_value(x: Column, kind: T.DataType, digits: int | None = 2) -> Column:
    """A value of any type with every number in it finite and, unless digits is None, rounded; null otherwise. Keys of maps become texts."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        number = finite(x.cast("double"))
        return number if digits is None else F.round(number, digits)
    if isinstance(kind, T.DecimalType):
        return x.cast("double") if digits is None else F.round(x.cast("double"), digits)
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda v: safe_value(v, kind.elementType, digits))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.transform(F.map_entries(x), lambda e: F.struct(F.coalesce(e["key"].cast("string"), F.lit("")), safe_value(e["value"], kind.valueType, digits))))
    if isinstance(kind, T.StructType):
        return F.when(x.isNotNull(), F.struct(*[safe_value(x[f.name], f.dataType, digits).alias(f.name) for f in kind.fields]))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss")
    if isinstance(kind, T.BinaryType):
        return F.base64(x)
    return x


def safe(df: DataFrame, digits: int | None = 2) -> DataFrame:
    return df.select(*[safe_value(F.col(f"`{f.name}`"), f.dataType, digits).alias(f.name) for f in df.schema.fields])


def json_rows(df: DataFrame, digits: int | None = 2) -> DataFrame:
    """(json): one document a row; null fields stay as null instead of being left out."""
    return safe(df, digits).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def write_json(df: DataFrame, path: str, digits: int | None = 2) -> None:
    """A folder of files of one document a line."""
    json_rows(df, digits).write.text(path)

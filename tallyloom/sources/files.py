"""Exports as frames of text cells: delimited text; previews. Workbooks are in workbooks.py."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fields import QueryError
from ..functions import text

MOST_BYTES, MOST_COLUMNS, SAMPLE_ROWS = 50 * 1024 * 1024, 100, 5
DELIMITERS = ",;\t|"


def delimiter_of(head: str) -> str:
    try:
        return csv.Sniffer().sniff(head[:2048], delimiters=DELIMITERS).delimiter
    except csv.Error:
        return ","


def within_limit(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> None:
    """An error if a file is empty or too large. Sizes come from the listing; no file is read."""
    largest = spark.read.format("binaryFile").load(path).agg(F.max("length"), F.min("length")).first()
    if not largest[1] or largest[0] > most_bytes:
        raise QueryError("the file is empty or too large")


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """A file of delimited text as string columns, so that 00123 stays. UTF-8, or Latin-1 where that isn't valid; the delimiter is found from the first lines."""
    if not path.lower().endswith(".csv"):
        raise QueryError("only .csv and .xlsx files are read")
    within_limit(spark, path)
    lines = spark.read.text(path)
    head = "\n".join(r[0] for r in lines.limit(20).collect())
    if not head:
        raise QueryError("the file is empty")
    encoding = "UTF-8" if lines.filter(~F.is_valid_utf8("value")).isEmpty() else "ISO-8859-1"
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, sep=delimiter_of(head), encoding=encoding, quote='"', escape='"')
    if len(df.columns) > MOST_COLUMNS:
        raise QueryError(f"at most {MOST_COLUMNS} columns")
    return df.toDF(*[c.lstrip("\ufeff") for c in df.columns])


def preview(df: DataFrame, personal: list[str] = (), rows: int = SAMPLE_ROWS) -> DataFrame:
    """The first rows, masked and cut to 120 characters; personal columns redacted."""
    return df.limit(rows).select(*[(text.redacted(F.col(f"`{c}`").cast("string")) if c in personal else text.masked(F.col(f"`{c}`").cast("string"), 120)).alias(c) for c in df.columns])

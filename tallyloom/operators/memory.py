"""What owners confirmed about the headers of their exports, and what follows for the next one.

The memory is a log of Parquet files. A confirmation or a deletion appends rows (a deletion has no field), never changes any, so
any number of writers work at once; the latest row of (owner, template, header) holds, of equal times the one with the greater
sequence. All operations take the exports of many owners together.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fields import BY_LABEL
from ..functions import text
from ..sources.stored import at_path, exists
from .headers import PERSONAL_TOKENS

LOG = "owner string, signature string, header string, field string, at timestamp, sequence string"
EMPTY = "__empty__"
KEY = ["owner", "signature", "header"]


def owner_key(owner: Column) -> Column:
    return F.sha2(F.lower(F.trim(owner)), 256)


def template_key(header: Column) -> Column:
    """A header as a template knows it: lower case, without marks, on one line; blank and unnamed ones are alike."""
    t = F.lower(F.ltrim(header, F.lit("\ufeff")))
    t = F.regexp_replace(F.regexp_replace(t, r"[_\-.:]+", " "), r"[\[\]()\"'`#]", " ")
    t = F.trim(F.regexp_replace(t, r"(?U)\s+", " "))
    return F.when(t.isNull() | (t == "") | t.rlike(r"^unnamed( \d+)?$"), EMPTY).otherwise(t)


def _escaped(x: Column) -> Column:
    """A JSON string in ASCII."""
    code = lambda c: F.ascii(c)
    pair = lambda c: F.format_string("\\u%04x\\u%04x", (F.lit(0xD800) + F.shiftright(code(c) - 0x10000, 10)).cast("int"), (F.lit(0xDC00) + (code(c) - 0x10000).bitwiseAND(0x3FF)).cast("int"))
    one = lambda c: F.when(c == "\\", "\\\\").when(code(c) < 128, c).when(code(c) < 0x10000, F.format_string("\\u%04x", code(c))).otherwise(pair(c))
    plain = x.rlike(r"^[\x00-\x5B\x5D-\x7F]*$")  # nearly all are: no need to go through their letters
    return F.concat(F.lit('"'), F.when(plain, x).otherwise(F.array_join(F.transform(F.filter(F.split(x, ""), lambda c: c != ""), one), "")), F.lit('"'))


def signature_of(keys: Column) -> Column:
    """The digest of an array of template keys, repeated ones included, whatever their order."""
    return F.substring(F.sha2(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(keys), _escaped), ","), F.lit("]")), 256), 1, 16)


def signature(headers: list[str | None]) -> str:
    """signature_of() of one list of headers, without a session."""
    keys = []
    for h in headers:
        t = re.sub(r"[_\-.:]+", " ", (h or "").lstrip("\ufeff").lower())
        t = " ".join(re.sub(r"[\[\]()\"'`#]", " ", t).split())
        keys.append(EMPTY if not t or re.fullmatch(r"unnamed( \d+)?", t) else t)
    return hashlib.sha256(json.dumps(sorted(keys), separators=(",", ":")).encode()).hexdigest()[:16]


def templates(headers: DataFrame, *event: str) -> DataFrame:
    """(owner, sheet, header, ...) -> + raw (the header as given), header (its key), signature of its sheet, and whether it is alone there. `event` tells several uploads of a sheet apart. An export has at most a hundred columns."""
    by = ["owner", "sheet", *event]
    keyed = headers.withColumns({"raw": F.col("header"), "header": template_key(F.col("header")), "owner": F.lower(F.trim("owner"))}).dropna(subset=by)
    own = [c for c in keyed.columns if c not in by]
    sheets = keyed.groupBy(*by).agg(F.collect_list(F.struct(*own)).alias("columns"))
    keys = F.transform("columns", lambda c: c["header"])
    signed = sheets.withColumns({"owner": owner_key(F.col("owner")), "keys": keys, "signature": signature_of(keys)})
    rows = signed.select(*by, "keys", "signature", F.explode("columns").alias("c")).select(*by, "keys", "signature", "c.*")
    alone = (F.size(F.filter("keys", lambda k: k == F.col("header"))) == 1) & (F.col("header") != EMPTY)
    return rows.withColumn("alone", alone).drop("keys")


def confirmations(confirmed: DataFrame) -> DataFrame:
    """(owner, sheet, header, field, selected, personal, at) of all headers of confirmed exports -> LOG rows.

    Only columns that the owner chose count, and no headers that a sheet has twice. A blank field forgets, even for personal
    columns; a field is kept unless the header or the values are personal, or there is no such field.
    """
    t = templates(confirmed, "at").filter(F.col("selected") & F.col("alone"))
    private = F.arrays_overlap(text.tokens(F.col("raw")), F.array(*[F.lit(p) for p in PERSONAL_TOKENS])) | F.coalesce("personal", F.lit(False))
    field = F.trim(F.coalesce("field", F.lit("")))
    rows = t.withColumn("field", field).filter((F.col("field") == "") | (F.col("field").isin(list(BY_LABEL)) & ~private))
    sequence = F.sha2(F.concat_ws("|", *KEY, "field", F.col("at").cast("string"), F.col("sheet").cast("string")), 256)
    return rows.select(*KEY, F.when(F.col("field") != "", F.col("field")).alias("field"), F.col("at").cast("timestamp").alias("at"), sequence.alias("sequence"))


def latest(log: DataFrame) -> DataFrame:
    """LOG -> the entries that hold: one for each (owner, signature, header), deleted ones left out. Old versions are dropped before the shuffle."""
    return log.groupBy(*KEY).agg(F.max_by(F.struct("field", "at", "sequence"), F.struct("at", "sequence")).alias("e")).select(*KEY, "e.*").filter("field is not null")


def remembered(log: DataFrame, headers: DataFrame) -> DataFrame:
    """(owner, sheet, header) of new exports -> (owner, sheet, header as given, field) that their owners confirmed for the same set of headers."""
    t = templates(headers).filter("alone").select("owner", "sheet", "raw", "signature", "header")
    known = latest(log).filter(F.col("field").isin(list(BY_LABEL))).select(*KEY, "field")
    return t.join(known, KEY).select("owner", "sheet", F.col("raw").alias("header"), "field")


def listing(log: DataFrame, owner: str | None = None) -> DataFrame:
    """(owner, signature, updated_at, mappings) of the templates that an owner, or all, has in memory."""
    live = latest(log if owner is None else log.filter(F.col("owner") == owner_key(F.lit(owner))))
    return live.groupBy("owner", "signature").agg(F.max("at").alias("updated_at"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("header", "field")))).alias("mappings"))


# ---------------------------------------------------------------- the log on storage


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).option("recursiveFileLookup", "true").parquet(path) if exists(spark, path) else spark.createDataFrame([], LOG)


def append(rows: DataFrame, path: str) -> None:
    """Each writer has a folder of its own below path: two commits into one folder would remove each other's files."""
    rows.write.parquet(f"{path}/{uuid.uuid4().hex}")


def confirm(spark: SparkSession, path: str, owner: str, mapping: dict[str, str], chosen: list[str], personal: list[str] = ()) -> None:
    """Remember what one owner confirmed for one export. mapping: {header: field or blank} of all its headers."""
    rows = [(owner, 0, h, f, h in chosen, h in personal) for h, f in mapping.items()]
    confirmed = spark.createDataFrame(rows, "owner string, sheet int, header string, field string, selected boolean, personal boolean").withColumn("at", F.current_timestamp())
    append(confirmations(confirmed).withColumn("sequence", F.concat("sequence", F.lit(uuid.uuid4().hex))).coalesce(1), path)


def forget(spark: SparkSession, path: str, owner: str, template: str | None = None, header: str | None = None) -> int:
    """Delete an entry, a template or all of an owner's memory; how many entries that were."""
    gone = latest(read_log(spark, path)).filter(F.col("owner") == owner_key(F.lit(owner)))
    if template is not None:
        gone = gone.filter(F.col("signature") == template)
    if header is not None:
        gone = gone.filter(F.col("header") == template_key(F.lit(header)))
    n = gone.count()
    if n:
        append(gone.select(*KEY, F.lit(None).cast("string").alias("field"), F.greatest(F.current_timestamp(), F.col("at") + F.expr("interval 1 microsecond")).alias("at"), F.lit(uuid.uuid4().hex).alias("sequence")), path)
    return n


def compact(spark: SparkSession, path: str) -> None:
    """Rewrite the log to the entries that hold. What other writers add meanwhile, or have not ended, stays; old rows go once the new ones are there."""
    fs, p = at_path(spark, path)
    before = [s.getPath() for s in fs.listStatus(p)]
    whole = [b for b in before if fs.exists(at_path(spark, f"{b}/_SUCCESS")[1])]
    if whole:
        append(latest(spark.read.schema(LOG).parquet(*[str(b) for b in whole])), path)
    for b in whole:
        fs.delete(b, True)

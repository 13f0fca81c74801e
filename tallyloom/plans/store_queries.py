"""Queries of stores, memory, claims, workbooks and streams, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import claims, memory, reports
from ..sources import json_sink, stored, workbooks
from ..sources.register import STAR, star_register
from ..sources.register_cache import cached
from ..streaming import events
from . import sql

BASE = sql.base()
BOOK_ROWS = 500


def customer_books(spark: SparkSession, d: str) -> DataFrame:
    """The customers as workbooks of BOOK_ROWS rows each: (path, content)."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    rows = c.select(F.floor(F.col("c_custkey") / BOOK_ROWS).alias("book"), F.col("c_custkey").alias("Code"), F.col("c_name").alias("Party"), F.col("c_acctbal").alias("Balance"), F.concat(F.lit("<"), "c_mktsegment", F.lit("> & co")).alias("Note"))
    return workbooks.books_of(rows, "book", "Code", {"Code": 8})


def datasets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A catalogue's log with a dataset for each order, what lies in the folder, and the time: made from orders and their lines."""
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("dataset"), F.col("o_custkey").cast("string").alias("owner"), F.concat(F.lit("register-"), F.col("o_orderkey")).alias("folder"), F.col("o_orderdate").cast("timestamp").alias("at"), "o_orderkey", "o_orderstatus")
    until = F.when(F.col("o_orderkey") % 4 > 0, F.col("at") + F.make_interval(days=F.col("o_orderkey").cast("int") % 3000))
    added = o.select("dataset", "owner", "folder", F.lit("register").alias("kind"), "at", until.alias("until"), F.lit(False).alias("dropped"))
    gone = o.filter("o_orderstatus = 'F' and o_orderkey % 5 = 0").select("dataset", "owner", "folder", F.lit("register").alias("kind"), (F.col("at") + F.expr("interval 1 day")).alias("at"), F.lit(None).cast("timestamp").alias("until"), F.lit(True).alias("dropped"))
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    there = lines.filter("l_orderkey % 7 <> 0").groupBy(F.concat(F.lit("register-"), F.col("l_orderkey")).alias("folder")).agg(F.sum(F.col("l_partkey")).alias("bytes"), F.max("l_shipdate").cast("timestamp").alias("modified"))
    half = lines.groupBy(F.concat(F.lit("half-"), F.col("l_suppkey")).alias("folder")).agg(F.sum("l_partkey").alias("bytes"), F.max("l_shipdate").cast("timestamp").alias("modified"))
    return added.unionByName(gone), there.unionByName(half), lines.agg(F.max("l_shipdate").cast("timestamp").alias("now"))


def catalogue_states(spark: SparkSession, d: str) -> DataFrame:
    entries, there, now = datasets(spark, d)
    return stored.judged(stored.current(entries), there, now.first()["now"]).select("folder", "dataset", "bytes", "state")


CATALOGUE_SQL = """WITH t AS (SELECT MAX(l_shipdate) AS now FROM lineitem), c AS (
 SELECT CAST(o_orderkey AS VARCHAR) AS dataset, 'register-' || o_orderkey AS c_folder, CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate + to_days(CAST(o_orderkey % 3000 AS INTEGER)) END AS until FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderkey % 5 = 0)
), f AS (
 SELECT 'register-' || l_orderkey AS folder, SUM(l_partkey) AS bytes, MAX(l_shipdate) AS modified FROM lineitem WHERE l_orderkey % 7 <> 0 GROUP BY 1
 UNION ALL SELECT 'half-' || l_suppkey, SUM(l_partkey), MAX(l_shipdate) FROM lineitem GROUP BY 1
)
SELECT COALESCE(folder, c_folder) AS folder, dataset, CAST(bytes AS BIGINT) AS bytes, CASE WHEN folder IS NULL THEN 'missing' WHEN c_folder IS NULL THEN CASE WHEN modified <= now - INTERVAL 120 MINUTE THEN 'orphan' ELSE 'fresh' END WHEN until <= now THEN 'expired' ELSE 'kept' END AS state
FROM f FULL OUTER JOIN c ON folder = c_folder CROSS JOIN t"""


def cached_totals(spark: SparkSession, d: str) -> DataFrame:
    """The category ledger of the register as the cache has it; a second call reads no table of the star."""
    register = cached(spark, f"{stored.shared_dir(spark)}/tallyloom-cache", [f"{d}/{t}.parquet" for t in STAR], None, lambda: star_register(spark, d))
    return reports.category_ledger(register)


def confirmed(spark: SparkSession, d: str, sheets: Callable) -> tuple[DataFrame, DataFrame]:
    """(confirmations, new exports): each customer confirms an export's headers; every other one does so again later."""
    s = sheets(spark, d).withColumn("owner", F.concat(F.lit(" Owner"), (F.col("sheet") % 50).cast("string")))
    field = F.when(F.col("expected").isin("none", "ambiguous"), "").otherwise(F.col("expected"))
    first = s.select("owner", "sheet", "header", field.alias("field"), ((F.col("sheet") + F.col("ordinal")) % 3 > 0).alias("selected"), (F.col("ordinal") == 4).alias("personal"), F.lit("2026-01-01 00:00:00").cast("timestamp").alias("at"))
    again = s.filter("sheet % 2 = 0").select("owner", "sheet", "header", F.when(F.col("sheet") % 4 == 0, "").otherwise("Item").alias("field"), (F.col("ordinal") % 4 == 1).alias("selected"), F.lit(False).alias("personal"), (F.lit("2026-01-02 00:00:00").cast("timestamp") + F.make_interval(secs=F.col("sheet"))).alias("at"))
    return memory.confirmations(first.unionByName(again)), s.select("owner", "sheet", "header")


def recalled(spark: SparkSession, d: str, sheets: Callable) -> DataFrame:
    log, new = confirmed(spark, d, sheets)
    return memory.remembered(log, new.withColumn("header", F.concat(F.lower("header"), F.lit(":"))).filter("sheet % 3 = 0"))


MEMORY_SQL = r""", s AS (SELECT sheet, ordinal, expected, sha2_owner AS owner, header, trim(regexp_replace(regexp_replace(regexp_replace(lower(ltrim(header, chr(65279))), '[_\-.:]+', ' ', 'g'), '[\[\]()"''`#]', ' ', 'g'), '\s+', ' ', 'g')) AS k FROM (SELECT *, sha256('owner' || (sheet % 50)) AS sha2_owner FROM h)),
 g AS (SELECT owner, sheet, md5(string_agg(k, '|' ORDER BY k)) AS sig FROM s GROUP BY 1, 2), n AS (SELECT owner, sheet, k, COUNT(*) AS times FROM s GROUP BY 1, 2, 3),
 t AS (SELECT s.*, sig, times = 1 AND s.k <> '' AS alone FROM s JOIN g USING (owner, sheet) JOIN n ON n.owner = s.owner AND n.sheet = s.sheet AND n.k = s.k),
 c AS (SELECT owner, sig, k, header, CASE WHEN expected IN ('none', 'ambiguous') THEN '' ELSE expected END AS field, ordinal = 4 AS personal, TIMESTAMP '2026-01-01' AS stamp, sheet FROM t WHERE alone AND (sheet + ordinal) % 3 > 0
  UNION ALL SELECT owner, sig, k, header, CASE WHEN sheet % 4 = 0 THEN '' ELSE 'Item' END, FALSE, TIMESTAMP '2026-01-02' + to_seconds(sheet), sheet FROM t WHERE alone AND sheet % 2 = 0 AND ordinal % 4 = 1),
 e AS (SELECT owner, sig, k, field, stamp FROM c WHERE field = '' OR NOT (personal OR regexp_matches(lower(header), '(^|[^a-z0-9])(email|mail|phone|mobile|contact|aadhaar|aadhar|pan|ssn|dob|birth|tel|cell)([^a-z0-9]|$)'))),
 l AS (SELECT owner, sig, k, field FROM e QUALIFY row_number() OVER (PARTITION BY owner, sig, k ORDER BY stamp DESC) = 1)"""


def facts_of(spark: SparkSession, d: str) -> DataFrame:
    """The numbers that texts may cite here: whole units and line counts by item, discounts in percent."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    by_part = lines.groupBy("l_partkey").agg(F.sum("l_quantity").alias("units"), F.count(F.lit(1)).cast("double").alias("n"))
    return by_part.select(F.explode(F.array("units", "n")).alias("value"))


FACTS_SQL = "f AS (SELECT unnest([SUM(l_quantity), COUNT(*)::DOUBLE]) AS value FROM lineitem GROUP BY l_partkey)"


def _listed(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


_TOKEN = claims.TOKEN.replace("'", "''")
_SCANNED = rf"""m AS (SELECT doc_id, regexp_extract_all(text, '{_TOKEN}') AS tokens, string_split_regex(text, '{_TOKEN}') AS parts FROM documents WHERE regexp_matches(text, '[0-9]')),
 u AS (SELECT doc_id, unnest(generate_series(1, len(tokens))) AS i, tokens, parts FROM m),
 w AS (SELECT doc_id, i - 1 AS position, trim(regexp_replace(tokens[i], '\s+', ' ', 'g')) AS token, regexp_extract(lower(parts[i]), '([a-z]+)\s*$', 1) AS before, regexp_extract(lower(parts[i + 1]), '^\s*([a-z]+)', 1) AS after FROM u),
 x AS (SELECT *, CAST(replace(regexp_extract(lower(token), '[0-9][0-9,]*(?:\.[0-9]+)?'), ',', '') AS DOUBLE) * CASE WHEN regexp_matches(lower(token), 'crore') THEN 1e7 WHEN regexp_matches(lower(token), 'lakh') THEN 1e5 ELSE 1.0 END AS value, rtrim(token, ',.; ') AS bare FROM w),
 y AS (SELECT doc_id, position, token, value, before, after, CASE
   WHEN regexp_full_match(token, '{claims.DATE}') OR before IN ({_listed(claims.MONTHS)}) OR after IN ({_listed(claims.MONTHS)}) THEN 'date'
   WHEN regexp_full_match(bare, '[0-9]+') AND after NOT IN ({_listed(claims.UNITS)}) AND value BETWEEN 1900 AND 2099 THEN 'year'
   WHEN after IN ('st', 'nd', 'rd', 'th') OR (value = floor(value) AND value BETWEEN 1 AND 10 AND (before IN ({_listed(claims.RANKS)}) OR after IN ({_listed(claims.RANKS)}))) THEN 'rank' ELSE 'claim' END AS kind FROM x)"""


def register(add: Callable, sheets: Callable, sheets_sql: Callable) -> None:
    text = lambda c: f"CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END"
    add("src04_workbooks", lambda s, d: workbooks.table_of(workbooks.cells(customer_books(s, d))), f"SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS \"Code\", c_name AS \"Party\", {text('c_acctbal')} AS \"Balance\", '<' || c_mktsegment || '> & co' AS \"Note\" FROM customer")
    add("src10_catalogue_states", catalogue_states, CATALOGUE_SQL)
    add("src11_cached_register", cached_totals, BASE + f", g AS (SELECT category AS label, {sql.TOTALS} FROM p GROUP BY 1) SELECT label, units, revenue, cost, profit, COALESCE(profit / NULLIF(revenue, 0) * 100, 0.0) AS margin_pct FROM g")
    numbers = "label string, units double, revenue double, odd double, far double, days array<double>"
    ledger = lambda r: reports.category_ledger(r).select("label", "units", "revenue", F.lit(float("nan")).alias("odd"), F.lit(float("-inf")).alias("far"), F.array("revenue", F.lit(float("inf"))).alias("days"))
    add("src12_json_rows", lambda s, d: json_sink.json_rows(ledger(star_register(s, d)), None).select(F.contains("json", F.lit("null")).alias("has_null"), F.from_json("json", numbers).alias("j")).select("has_null", "j.label", "j.units", "j.revenue", "j.odd", "j.far", F.col("j.days")[0].alias("first"), F.col("j.days")[1].alias("second")), BASE + f", g AS (SELECT category AS label, {sql.TOTALS} FROM p GROUP BY 1) SELECT TRUE AS has_null, label, units, revenue, CAST(NULL AS DOUBLE) AS odd, CAST(NULL AS DOUBLE) AS far, revenue AS first, CAST(NULL AS DOUBLE) AS second FROM g")
    add("src14_mapping_memory", lambda s, d: memory.latest(confirmed(s, d, sheets)[0]).select("owner", F.col("header").alias("key"), "field", "at").withColumn("at", F.col("at").cast("timestamp_ntz")), f"WITH {sheets_sql()}" + MEMORY_SQL.replace("l AS (SELECT owner, sig, k, field FROM e", "l AS (SELECT owner, sig, k, field, stamp FROM e") + " SELECT owner, k AS key, field, stamp AS \"at\" FROM l WHERE field <> ''")
    add("map17_recalled_fields", lambda s, d: recalled(s, d, sheets), f"WITH {sheets_sql()}" + MEMORY_SQL + " SELECT t.owner, sheet, lower(header) || ':' AS header, field FROM t JOIN l ON t.owner = l.owner AND t.sig = l.sig AND t.k = l.k WHERE alone AND sheet % 3 = 0 AND field <> ''")
    docs = lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    add("grd01_numbers_in_texts", lambda s, d: claims.scanned(docs(s, d)).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most"), F.sum("position").alias("places")), f"WITH {_SCANNED} SELECT doc_id, kind, COUNT(*) AS n, MAX(value) AS most, CAST(SUM(position) AS BIGINT) AS places FROM y GROUP BY 1, 2")
    add("grd01_unsupported_claims", lambda s, d: claims.checked(docs(s, d), facts_of(s, d)).select("doc_id", "position", "token", "value"), f"WITH {_SCANNED}, {FACTS_SQL} SELECT doc_id, CAST(position AS INTEGER) AS position, token, value FROM y WHERE kind = 'claim' AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT value AS fact FROM f) WHERE abs(y.value - fact) <= GREATEST(0.5, 0.005 * abs(fact)))")
    read = lambda s, d: s.read.parquet(f"{d}/events.parquet")
    add("stream_sessions_streamed", lambda s, d: events.streamed(read(s, d), events.sessions).withColumn("start", F.col("start").cast("timestamp_ntz")), "WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), k AS (SELECT user_id, ts, SUM(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, MIN(ts) AS start, COUNT(*) AS n FROM k GROUP BY user_id, k")
    add("stream_tumbling_streamed", lambda s, d: events.streamed(read(s, d), events.tumbling).withColumn("start", F.col("start").cast("timestamp_ntz")), f"SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, COUNT(*) AS n, {sql.s('value')} AS total FROM events GROUP BY 1, 2")

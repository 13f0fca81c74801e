"""Queries of column understanding and of the dashboard's rules, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import charts, evidence, extras, headers, insights, inventory, reports, slicing
from ..operators import understanding as u
from ..operators.slicing import AnalysisQuery, build_slice
from ..sources.register import ROW_ORDER, star_days, star_register
from . import sql

DAYS30 = AnalysisQuery("30days")
BASE, BASE30 = sql.base(), sql.base(sql.last_days(30)[0])
RAW = ["GST %", "Disc %", "Bill Amount", "Line Amount", "Rate", "Due Date", "Name", "Phone", "Notes"]
FIELDS = {"Invoice No": "invoice_no", "Quantity": "quantity", "Selling Price": "selling_price"}
SHAPED = ["quantity", "category", "invoice_no", "sale_date"]
SCORES = [("quantity", "quantity", 0.95), ("quantity", "unit_price", 0.60), ("category", "category", 0.90), ("category", "product", 0.88), ("invoice_no", "id", 0.85), ("invoice_no", "other", 0.20), ("sale_date", "date", 0.10), ("sale_date", "status", 0.05)]


def raw_columns(spark: SparkSession, d: str) -> DataFrame:
    """The register with some columns under the headers of an export: the input of the evidence rules. Some invoice numbers are missing, some bill amounts have a sign and commas, some are none."""
    r = star_register(spark, d)
    slab = F.element_at(F.array(*[F.lit(x) for x in u.SLABS_PERCENT]), (F.col("k1") % 5 + 1).cast("int"))
    number = F.when(F.col("k1") % 11 == 0, " N/A ").when(F.col("k1") % 13 == 0, None).otherwise(F.concat(F.lit(" "), "invoice_no"))
    bill = F.col("x_meas_order_total").cast("decimal(20,2)")
    bill = F.when(F.col("k2") % 17 == 0, None).when(F.col("k4") % 2 == 0, F.concat(F.lit("₹ "), F.format_number(bill, 2))).when(F.col("k2") % 19 == 0, "as agreed").otherwise(bill.cast("string"))
    return r.select(number.alias("invoice_no"), "quantity", "selling_price", "line_total", slab.alias("GST %"), F.round(F.col("discount") / F.col("line_total") * 100).alias("Disc %"), bill.alias("Bill Amount"), F.col("line_total").alias("Line Amount"), F.col("selling_price").alias("Rate"))


def _rows(values: list[tuple]) -> str:
    cell = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, v)) + ")" for v in values) + ")"


def _names(names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]::VARCHAR[]"


def register(add: Callable, sheets: Callable, sheets_sql: Callable, guess: str) -> None:
    whole = lambda run: lambda spark, d: run(star_register(spark, d))
    sliced = lambda run: lambda spark, d: run(build_slice(star_register(spark, d), DAYS30, star_days(spark, d)))

    # shapes and scores
    cells = " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS t FROM cur" for c in SHAPED)
    number, day = "TRY_CAST(t AS DOUBLE) IS NOT NULL", "TRY_CAST(t AS DOUBLE) IS NULL AND TRY_CAST(t AS TIMESTAMP) IS NOT NULL"
    one = "CASE WHEN {} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    shapes = BASE + f", c AS ({cells}), sh AS (SELECT col, AVG({one.format(number)}) AS nr, AVG({one.format(day)}) AS dr FROM c GROUP BY 1)"
    shape = BASE + f", c AS ({cells}) SELECT col AS \"column\", AVG({one.format('t IS NULL')}) AS null_ratio, AVG({one.format(number)}) AS numeric_ratio, AVG({one.format(day)}) AS date_ratio, COUNT(DISTINCT t) / COUNT(t)::DOUBLE AS unique_ratio, AVG(length(t))::DOUBLE AS mean_length, bool_and(COALESCE(TRY_CAST(t AS DOUBLE) = round(TRY_CAST(t AS DOUBLE)), FALSE)) AS all_integer FROM c WHERE col <> 'sale_date' GROUP BY 1"
    shaped = lambda s, d, columns: evidence.shape(star_register(s, d, orders_last=True).select(*columns), columns)
    add("map10_shape", lambda s, d: shaped(s, d, SHAPED[:3]), shape)
    labels = _rows([(k, 0.0, 1.0) for k in ("date",)] + [(k, 1.0, 0.0) for k in ("quantity", "unit_price", "mrp", "cost", "revenue", "discount", "tax")] + [(k, 0.0, 0.0) for k in ("id", "product", "category", "customer", "region", "status", "notes", "other")])
    fit = shapes + f", lb AS (SELECT * FROM {labels} t(label, n, d)), fits AS (SELECT col, label, CASE WHEN n = 0 AND d = 0 THEN 1 - abs(nr - n) ELSE ((1 - abs(nr - n)) + (1 - abs(dr - d))) / 2 END AS fit FROM sh, lb)"
    fits = lambda s, d: u.shape_fit(shaped(s, d, SHAPED))
    add("map11_shape_fit", fits, fit + ' SELECT col AS "column", label, fit FROM fits')
    blend = fit + f", hs AS (SELECT * FROM {_rows(SCORES)} t(col, label, score)), b0 AS (SELECT hs.col, hs.label, score, 0.7::DOUBLE * score + 0.3::DOUBLE * COALESCE(fit, 0) AS blend FROM hs LEFT JOIN fits USING (col, label)), b1 AS (SELECT *, row_number() OVER w AS r, COALESCE(lead(blend) OVER w, 0.0) AS next, MAX(score) OVER (PARTITION BY col) > 0.15 AS known FROM b0 WINDOW w AS (PARTITION BY col ORDER BY blend DESC, label))"
    add("map13_blend_and_route", lambda s, d: u.blended(s.createDataFrame(SCORES, "column string, label string, score double"), fits(s, d)), blend + " SELECT col AS \"column\", CASE WHEN known THEN label ELSE 'other' END AS label, CASE WHEN known THEN round(blend, 4) ELSE 0.0 END AS score, CASE WHEN known THEN round(blend - next, 4) ELSE 0.0 END AS margin, CASE WHEN NOT known THEN 'unknown' WHEN label IN ('currency', 'status', 'notes') THEN 'local' WHEN blend >= 0.8 AND blend - next >= 0.05 THEN 'local' ELSE 'ask' END AS route FROM b1 WHERE r = 1")

    # headers
    fields = {"date": "Date", "quantity": "Quantity", "unit_price": "Selling Price", "cost": "Cost Price", "revenue": "Line Total", "discount": "Discount", "tax": "Tax", "product": "Item", "category": "Category", "customer": "Customer", "region": "Branch", "mrp": "MRP"}
    by_field = " ".join(f"WHEN field = '{f}' THEN '{k}'" for k, f in fields.items())
    unused = " ".join(f"WHEN lower(ltrim(trim(header), chr(65279))) IN ({', '.join(repr(n) for n in names)}) THEN '{label}'" for label, names in u.UNUSED_HEADERS.items())
    personal = f"regexp_matches(lower(header), '(^|[^a-z0-9])({'|'.join(headers.PERSONAL_TOKENS)})([^a-z0-9]|$)')"
    label = f"CASE {by_field} WHEN field = 'Invoice No' THEN 'id' ELSE 'other' END"
    known = guess + f""", ch AS (SELECT sheet, ordinal, header, CASE WHEN {personal} THEN 'personal' WHEN confidence = 'exact' THEN {label} {unused} WHEN confidence = 'fuzzy' THEN {label} ELSE 'other' END AS label,
 CASE WHEN confidence = 'exact' OR (confidence = 'fuzzy' AND (CASE {unused} END) IS NULL) THEN field END AS field, CASE WHEN confidence = 'exact' THEN 1.0::DOUBLE WHEN {personal} THEN 0.0 WHEN (CASE {unused} END) IS NOT NULL THEN 1.0 WHEN confidence = 'fuzzy' THEN 0.5 ELSE 0.0 END AS score, CASE WHEN confidence = 'exact' THEN 'dictionary' ELSE 'local' END AS source FROM q)"""
    add("map14_classified_headers", lambda s, d: u.classified_headers(sheets(s, d).drop("expected")), known + " SELECT sheet, ordinal, header, label, field, score, source FROM ch")
    resolved = known + f""", k0 AS (SELECT *, field IS NULL OR row_number() OVER (PARTITION BY sheet, field ORDER BY ordinal) = 1 AS kept FROM ch), k1 AS (SELECT sheet, ordinal, header, label, CASE WHEN kept THEN field END AS field, score, CASE WHEN NOT kept THEN 'low' WHEN score >= 0.9 THEN 'high' WHEN score >= 0.65 THEN 'medium' ELSE 'low' END AS band, source FROM k0),
 rs AS (SELECT *, label NOT IN ('currency', 'status', 'notes', 'personal') AND (field IS NULL OR band = 'low') AS needs_review FROM k1)"""
    add("map16_resolved_headers", lambda s, d: u.resolved(u.classified_headers(sheets(s, d)), "sheet"), resolved + " SELECT sheet, ordinal, header, label, field, score, band, source, needs_review FROM rs")
    labels_ = [*u.EXPECTED_SHAPE, "currency"]
    names_ = ["Bill No", "Customer Id", "Sr. No"]
    document = " OR ".join(f"contains(lower(header), '{w}')" for w in u.DOCUMENT_WORDS)
    translate = f"SELECT sheet, label, header, CASE WHEN label = 'id' AND ({document}) THEN 'Invoice No' {' '.join(f'WHEN label = {k!r} THEN {f!r}' for k, f in fields.items())} END AS field FROM (SELECT c_custkey AS sheet, ({_names(labels_)})[CAST(c_custkey % {len(labels_)} + 1 AS INTEGER)] AS label, ({_names(names_)})[CAST(c_custkey % 3 + 1 AS INTEGER)] || ' ' || c_mktsegment AS header FROM customer)"
    pick = lambda names: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("c_custkey") % len(names) + 1).cast("int"))
    labelled = lambda s, d: s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("sheet"), pick(labels_).alias("label"), F.concat_ws(" ", pick(names_), "c_mktsegment").alias("header"))
    add("map15_fields_of_labels", lambda s, d: labelled(s, d).withColumn("field", u.field_of(F.col("label"), F.col("header"))), translate)
    found = [("Total", "auto", None, "invoice_total", 0.97), ("Store Code", "auto", "Branch", "region", 0.92), ("Cashier Name", "ask", None, None, 0.0), ("Customer Phone", "auto", "Customer", "customer", 0.95)]
    memory = [("store code", "Category"), ("cashier name", "Customer"), ("customer phone", "Customer"), ("date", "Date")]
    settle = resolved + f""", ev AS (SELECT c_custkey AS e_sheet, t.* FROM customer, {_rows(found)} t(e_header, decision, e_field, semantic, confidence) WHERE c_custkey % 2 = 0), me AS (SELECT c_custkey AS m_sheet, t.* FROM customer, {_rows(memory)} t(m_header, m_field) WHERE c_custkey % 3 = 0),
 j1 AS (SELECT rs.*, decision, e_field, semantic, confidence, m_field, {personal} OR label = 'personal' AS pii FROM rs LEFT JOIN ev ON sheet = e_sheet AND header = e_header LEFT JOIN me ON sheet = m_sheet AND lower(ltrim(trim(header), chr(65279))) = m_header),
 j2 AS (SELECT *, needs_review AND NOT pii AND COALESCE(decision = 'auto', FALSE) AS auto FROM j1), j3 AS (SELECT *, needs_review AND NOT pii AND NOT auto AND m_field IS NOT NULL AS recalled, auto AND m_field IS NOT NULL AND e_field IS NOT NULL AND m_field <> e_field AS conflict FROM j2)
 SELECT sheet, ordinal, header, CASE WHEN pii THEN 'personal' WHEN auto THEN COALESCE(semantic, label) ELSE label END AS label, CASE WHEN pii THEN NULL WHEN auto THEN e_field WHEN recalled THEN m_field ELSE field END AS field,
 CASE WHEN pii THEN 0.0::DOUBLE WHEN auto THEN confidence WHEN recalled THEN 0.95 ELSE score END AS score, CASE WHEN pii THEN 'low' WHEN auto THEN CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.65 THEN 'medium' ELSE 'low' END WHEN recalled THEN 'high' ELSE band END AS band,
 CASE WHEN pii THEN 'local' WHEN auto THEN 'evidence' WHEN recalled THEN 'memory' ELSE source END AS source, CASE WHEN pii OR recalled THEN FALSE WHEN auto THEN conflict ELSE needs_review END AS needs_review, conflict AS memory_conflict FROM j3"""
    every = lambda s, d, n, rows, schema: s.read.parquet(f"{d}/customer.parquet").filter(F.col("c_custkey") % n == 0).select(F.col("c_custkey").alias("sheet")).crossJoin(F.broadcast(s.createDataFrame(rows, schema)))  # noqa: E731  a fixed table
    add("map18_settled_headers", lambda s, d: u.settled(u.resolved(u.classified_headers(sheets(s, d)), "sheet"), every(s, d, 2, found, "header string, decision string, field string, semantic string, confidence double"), every(s, d, 3, memory, "header string, field string"), "sheet"), settle)
    scored = guess + ", z AS (SELECT COALESCE(field, 'none') AS predicted, expected FROM q WHERE expected <> 'ambiguous')"
    predicted = lambda s, d: headers.guessed(sheets(s, d)).withColumnRenamed("field", "predicted")
    add("map20_role_scores", lambda s, d: headers.role_scores(predicted(s, d)), scored + ", r AS (SELECT expected AS role FROM z UNION SELECT predicted FROM z) SELECT role, COUNT(*) FILTER (WHERE expected = role) AS support, COUNT(*) FILTER (WHERE expected = role AND predicted = role) / NULLIF(COUNT(*) FILTER (WHERE predicted = role), 0)::DOUBLE AS \"precision\", COUNT(*) FILTER (WHERE expected = role AND predicted = role) / NULLIF(COUNT(*) FILTER (WHERE expected = role), 0)::DOUBLE AS recall FROM r JOIN z ON role = expected OR role = predicted GROUP BY 1")
    add("map20_confusions", lambda s, d: headers.confusions(predicted(s, d)), scored + " SELECT expected, predicted, COUNT(*) AS n FROM z WHERE expected <> predicted GROUP BY 1, 2 ORDER BY n DESC, expected, predicted LIMIT 10")
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    ascii_, wide = "".join(map(chr, range(0x20, 0x7F))), "\u3000" + "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
    spelled = {
        "upper": "upper(header)", "title": "array_to_string(list_transform(string_split(lower(header), ' '), lambda x: upper(x[1:1]) || x[2:]), ' ')", "pad_spaces": "'  ' || header || '  '", "double_internal_space": "regexp_replace(header, '^([^ ]*) ', '\\1  ')",
        "bom_prefix": "chr(65279) || header", "bom_then_space": "chr(65279) || ' ' || header", "space_then_bom": "' ' || chr(65279) || header", "underscore_for_space": "replace(header, ' ', '_')", "space_for_underscore": "replace(header, '_', ' ')",
        "hyphen_for_space": "replace(header, ' ', '-')", "trailing_colon": "header || ':'", "trailing_dot": "header || '.'", "nbsp_for_space": "replace(header, ' ', chr(160))", "tab_for_space": "replace(header, ' ', chr(9))",
        "fullwidth": f"translate(header, {quoted(ascii_)}, {quoted(wide)})",
    }
    spellings = " UNION ALL ".join(f"SELECT sheet, ordinal, '{k}' AS kind, header AS plain, {v} AS header FROM h" for k, v in spelled.items())
    add("map21_perturbed_headers", lambda s, d: headers.perturbed(sheets(s, d, "supplier").drop("expected")), f"WITH {sheets_sql('supplier')} SELECT sheet, ordinal, kind, header FROM ({spellings}) WHERE header <> plain")

    # evidence rules
    raw = BASE + ", raw AS (SELECT CASE WHEN k1 % 11 <> 0 AND k1 % 13 <> 0 THEN invoice_no END AS invoice_no, quantity, selling_price, line_total, (ARRAY[0.0, 5.0, 12.0, 18.0, 28.0]::DOUBLE[])[CAST(k1 % 5 + 1 AS INTEGER)] AS gst, round(discount / line_total * 100) AS disc, CASE WHEN k2 % 17 = 0 OR (k4 % 2 <> 0 AND k2 % 19 = 0) THEN NULL ELSE CAST(CAST(x_meas_order_total AS DECIMAL(20,2)) AS DOUBLE) END AS bill, selling_price AS rate FROM cur)"
    slabs = ", ".join(f"{x}::DOUBLE" for x in (0.0, 5.0, 12.0, 18.0, 28.0))
    fractions = ", ".join(f"{x}::DOUBLE" for x in (0.0, 0.05, 0.12, 0.18, 0.28))
    facts = lambda c: f"SELECT COUNT(*) AS n, GREATEST(AVG({one.format(f'{c} IN ({slabs})')}), AVG({one.format(f'{c} IN ({fractions})')})) AS slab, COUNT(DISTINCT {c}) AS k, AVG({one.format(f'{c} BETWEEN 0 AND 100')}) AS within FROM raw WHERE {c} IS NOT NULL"
    tax = "n >= 5 AND slab >= 0.9 AND k <= 6"
    percent = lambda h, c: f"SELECT '{h}' AS header, CASE WHEN {tax} THEN 'auto' ELSE 'ask' END AS decision, CASE WHEN {tax} THEN 'Tax' END AS field, CASE WHEN {tax} THEN 'tax' END AS semantic, CASE WHEN {tax} THEN round(slab, 4) ELSE 0.0 END AS confidence, CASE WHEN {tax} THEN {_names(['Tax'])} WHEN n >= 5 AND within >= 0.9 THEN {_names(['Discount', 'Tax'])} ELSE {_names([])} END AS candidates FROM ({facts(c)})"
    repeat = lambda c: f"(SELECT AVG({one.format('d = 1')}) AS rep, COUNT(*) AS groups FROM (SELECT invoice_no, COUNT({c}) AS k, COUNT(DISTINCT {c}) AS d FROM raw WHERE invoice_no IS NOT NULL GROUP BY 1) WHERE k >= 2)"
    match = lambda price, total: f"(SELECT AVG({one.format(f'abs(quantity * {price} - {total}) <= GREATEST(abs({total}) * 0.01, 0.01)')}) AS hit, COUNT(*) AS tested FROM raw WHERE quantity > 0 AND {price} > 0 AND {total} IS NOT NULL)"
    ask = lambda h, names: f"SELECT '{h}' AS header, 'ask' AS decision, CAST(NULL AS VARCHAR) AS field, CAST(NULL AS VARCHAR) AS semantic, 0.0::DOUBLE AS confidence, {_names(names)} AS candidates"
    amount = lambda h, c: f"SELECT '{h}' AS header, CASE WHEN (groups >= 2 AND rep >= 0.9) OR hit >= 0.9 THEN 'auto' ELSE 'ask' END AS decision, CASE WHEN groups >= 2 AND rep >= 0.9 THEN NULL WHEN hit >= 0.9 THEN 'Line Total' END AS field, CASE WHEN groups >= 2 AND rep >= 0.9 THEN 'invoice_total' WHEN hit >= 0.9 THEN 'revenue' END AS semantic, CASE WHEN groups >= 2 AND rep >= 0.9 THEN round(rep, 4) WHEN hit >= 0.9 THEN round(hit, 4) ELSE 0.0 END AS confidence, CASE WHEN groups >= 2 AND rep >= 0.9 THEN {_names([])} ELSE {_names(['Line Total'])} END AS candidates FROM {repeat(c)}, {match('selling_price', c)}"
    rate = f"SELECT 'Rate' AS header, CASE WHEN hit >= 0.9 THEN 'auto' ELSE 'ask' END AS decision, CASE WHEN hit >= 0.9 THEN 'Selling Price' END AS field, CASE WHEN hit >= 0.9 THEN 'unit_price' END AS semantic, CASE WHEN hit >= 0.9 THEN round(hit, 4) ELSE 0.0 END AS confidence, {_names(['Selling Price'])} AS candidates FROM {match('rate', 'line_total')}"

    def verdicts(columns: list[str], fields: dict[str, str]) -> Callable:
        return lambda s, d: u.verdicts(raw_columns(s, d), columns, fields).withColumn("candidates", F.concat_ws(",", "candidates"))

    flat = lambda q: f"{raw} SELECT header, decision, field, semantic, confidence, array_to_string(candidates, ',') AS candidates FROM ({q})"
    add("evd01_percentage_rule", verdicts(["GST %", "Disc %"], FIELDS), flat(percent("GST %", "gst") + " UNION ALL " + percent("Disc %", "disc")))
    add("evd02_amount_rule", verdicts(["Bill Amount", "Line Amount"], FIELDS), flat(amount("Bill Amount", "bill") + " UNION ALL " + amount("Line Amount", "line_total")))
    add("evd02_amount_claimed", verdicts(["Bill Amount"], FIELDS | {"Line Total": "line_total"}), flat(ask("Bill Amount", ["Line Total"])))
    add("evd03_rate_rule", verdicts(["Rate"], {"Quantity": "quantity", "Line Total": "line_total", "Invoice No": "invoice_no"}), flat(rate))
    names = {"person": ["Name", "Phone", "City"], "thing": ["Name", "HSN Code", "Size"], "both": ["Name", "Phone", "SKU"], "neither": ["Name", "Notes"]}
    hits = lambda hs, words: len({w for h in hs[1:] for w in h.lower().split()} & set(words))
    counts = _rows([(i, hits(hs, ["phone", "mobile", "email", "address", "gstin", "gst", "contact", "pincode", "city"]), hits(hs, ["sku", "hsn", "barcode", "code", "style", "category", "size", "colour", "color", "brand", "unit"])) for i, hs in enumerate(names.values())])
    own = lambda s, d: s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("sheet"), F.lit(0).alias("ordinal"), F.lit("Name").alias("header"), F.concat_ws(" ", F.element_at(F.array(*[F.lit(" ".join(hs[1:])) for hs in names.values()]), (F.col("c_custkey") % 4 + 1).cast("int")), "c_mktsegment").alias("others"))
    add("evd04_name_rule", lambda s, d: u.name_rules(own(s, d)).select("sheet", "decision", "field", "confidence"), f"SELECT c_custkey AS sheet, CASE WHEN (p > 0) <> (g > 0) THEN 'auto' ELSE 'ask' END AS decision, CASE WHEN p > 0 AND g = 0 THEN 'Customer' WHEN g > 0 AND p = 0 THEN 'Item' END AS field, CASE WHEN (p > 0) <> (g > 0) THEN round(LEAST(0.90::DOUBLE + 0.02::DOUBLE * GREATEST(p, g), 0.99), 4) ELSE 0.0 END AS confidence FROM customer JOIN {counts} t(i, p, g) ON c_custkey % 4 = i")
    call = lambda s, d: s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("sheet"), F.concat_ws(" ", F.element_at(F.array(*[F.lit(h) for h in RAW]), (F.col("c_custkey") % len(RAW) + 1).cast("int")), F.col("c_mktsegment")).alias("header"))
    within = lambda ws: " OR ".join(f"contains(k, '{w}')" for w in ws)
    has = lambda ws: f"len(list_intersect(w, {_names(ws)})) > 0"
    add("evd05_rules_of_headers", lambda s, d: call(s, d).withColumn("rule", u.rule_of(F.col("header"))), f"WITH c AS (SELECT c_custkey AS sheet, ({_names(RAW)})[CAST(c_custkey % {len(RAW)} + 1 AS INTEGER)] || ' ' || c_mktsegment AS header FROM customer), h AS (SELECT sheet, header, lower(trim(header)) AS k, list_filter(regexp_split_to_array(lower(trim(header)), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM c) SELECT sheet, header, CASE WHEN contains(k, '%') OR {has(['pct', 'percent', 'percentage', 'gst', 'vat'])} THEN 'percentage' WHEN {within(['amount', 'amt', 'total', 'value', 'net', 'gross'])} THEN 'amount' WHEN {within(['rate', 'price', 'sp', 'cost', 'cp', 'mrp'])} THEN 'rate' WHEN {has(['name'])} AND NOT ({has(['product', 'item', 'brand', 'style', 'model', 'sku', 'article'])}) THEN 'name' WHEN {has(['due', 'delivery', 'delivered', 'ship', 'shipped', 'dispatch', 'eta', 'expiry', 'expiration', 'expected', 'promised', 'return', 'refund', 'manufacture', 'mfg', 'supplier'])} THEN 'later_date' END AS rule FROM h")
    guard = lambda s, d: u.line_total_guard(raw_columns(s, d), "Bill Amount", "invoice_no").withColumn("header", F.lit("Bill Amount")).unionByName(u.line_total_guard(raw_columns(s, d), "Line Amount", "invoice_no").withColumn("header", F.lit("Line Amount")))
    verdict = lambda h, c: f"SELECT '{h}' AS header, CASE WHEN groups >= 2 AND rep >= 0.9 THEN 'reject' WHEN groups = 1 AND rep = 1 THEN 'warn' ELSE 'ok' END AS verdict, groups FROM {repeat(c)}"
    add("evd06_line_total_guard", guard, raw + " " + verdict("Bill Amount", "bill") + " UNION ALL " + verdict("Line Amount", "line_total"))

    # the dashboard's rules
    demand = ", z AS (SELECT item, units, velocity, LEAST(GREATEST(CASE WHEN early > 0 AND late > 0 THEN late / early WHEN late > 0 THEN 2.0 ELSE 0.5 END, 0.25), 4.0) AS trend FROM i2), zt AS (SELECT item, velocity * trend * 14 AS expected FROM z ORDER BY units DESC, item LIMIT 20)"
    add("jn09_inventory_with_demand", sliced(lambda s: inventory.with_demand(inventory.intelligence(s.current, ROW_ORDER), inventory.item_demand(s.current, ROW_ORDER, 14)).select("item", "priority", "expected")), BASE30 + sql.INVENTORY + demand + " SELECT inv.item, priority, expected FROM inv LEFT JOIN zt USING (item)")
    z = "CASE WHEN mad > 0 THEN 0.6745::DOUBLE * (revenue - med) / mad ELSE (revenue - med) / NULLIF(sd, 0) END"
    odd = sql.DAILY + f", a2 AS (SELECT median(revenue) AS med, {sql.six('stddev_pop(revenue)')} AS sd FROM daily), a3 AS (SELECT median(abs(revenue - med)) AS mad FROM daily, a2)"
    add("jn10_days_with_anomalies", whole(lambda r: insights.anomalous_days(reports.daily(r), insights.anomalies(r)).select("day", "revenue", "units")), BASE + odd + f" SELECT day, revenue, units FROM daily, a2, a3 WHERE abs({z}) >= 2")
    add("srt10_inventory_by_cover", sliced(lambda s: inventory.resorted(inventory.intelligence(s.current, ROW_ORDER), "days_cover", True).select("item", "days_cover")), BASE30 + sql.INVENTORY + " SELECT item, days_cover FROM inv ORDER BY COALESCE(days_cover, 0), item LIMIT 12")
    chart = sql.chart("item", "profit", sql.last_days(30)[0], True, False)
    add("srt11_treemap_cells", sliced(lambda s: charts.treemap_cells(charts.chart(s.current, "item", "profit")).select("label", "value")), f"SELECT label, value FROM ({chart}) WHERE value > 0")
    add("srt12_donut_request", sliced(lambda s: charts.requested(s.current, "donut", "day", "revenue")), sql.chart("category", "revenue", sql.last_days(30)[0], True, False, 6))
    ends = "row_number() OVER (ORDER BY sale_date, k1, k2, k3, k4, line_total)"
    back = "row_number() OVER (ORDER BY sale_date DESC, k1 DESC, k2 DESC, k3 DESC, k4 DESC, line_total DESC)"
    add("set03_head_and_tail", whole(lambda r: slicing.head_and_tail(r.select("sale_date", *ROW_ORDER), ["sale_date", *ROW_ORDER], 3)), BASE + f", o AS (SELECT sale_date, {sql.ORDER}, {ends} AS a, {back} AS b FROM cur) SELECT sale_date, {sql.ORDER} FROM o WHERE a <= 3 OR b <= 3")
    full = {"quantity", "cost_price", "discount", "mrp", "selling_price", "stock_on_hand"}
    cards = [("card", k, all(x in full for x in needs)) for k, needs in extras.CARDS.items()]
    counted = BASE + ", n AS (SELECT COUNT(DISTINCT CAST(sale_date AS DATE)) AS sale_date, COUNT(DISTINCT category) AS category, COUNT(DISTINCT item) AS item, COUNT(DISTINCT branch) AS branch, COUNT(DISTINCT payment_mode) AS payment_mode, COUNT(*) AS n_rows FROM cur)"
    blank = lambda needs: " AND ".join([f"(SELECT COUNT(*) FILTER (WHERE {x} IS NULL) FROM cur) = 0" for x in needs if x in ("quantity", "selling_price", "cost_price", "discount", "mrp", "stock_on_hand")] or ["TRUE"])
    rows = [f"SELECT 'card' AS kind, '{k}' AS name, n_rows > 0 AND {blank(extras.CARDS[k])} AS available FROM n" for _, k, _ in cards]
    rows += [f"SELECT 'chart', '{k}', n_rows > 0 AND {blank(needs)} AND {f'{dimension} >= {least}' if dimension else 'TRUE'} FROM n" for k, (needs, dimension, least) in extras.CHARTS.items()]
    add("sch01_cards_and_charts", whole(lambda r: extras.cards_and_charts(r).select("kind", "name", "available")), counted + " " + " UNION ALL ".join(rows))
    add("fn10_texts", whole(lambda r: extras.share_texts(reports.revenue_mix(r))), BASE + f", g AS (SELECT category AS label, {sql.TOTALS} FROM p GROUP BY 1) SELECT label, printf('%.1f%%', revenue / {sql.over('revenue')} * 100) AS share_text FROM g WHERE revenue > 0 ORDER BY revenue DESC, label LIMIT 6")

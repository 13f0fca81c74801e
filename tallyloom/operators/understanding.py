"""What a column means: shape fit, blended scores, evidence rules, collisions, and the order in which sources are believed.

The rules of all columns are answered together, by aggregates with a row for each column; a verdict is a row
(decision, field, semantic, confidence, candidates), decision being auto or ask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .evidence import LEAST_INVOICES, LEAST_ROWS, MATCH, NUMERIC_SHARE, REPEAT, SLAB_MOST, SLAB_SHARE, TOLERANCE, invoice_of, invoice_repeat, repeat_groups
from .headers import is_personal, looked_up

# What share of a label's values is expected to be numbers, and dates.
EXPECTED_SHAPE: dict[str, tuple[float, float]] = {
    "date": (0.0, 1.0), "quantity": (1.0, 0.0), "unit_price": (1.0, 0.0), "mrp": (1.0, 0.0), "cost": (1.0, 0.0), "revenue": (1.0, 0.0), "discount": (1.0, 0.0), "tax": (1.0, 0.0),
    "id": (0.0, 0.0), "product": (0.0, 0.0), "category": (0.0, 0.0), "customer": (0.0, 0.0), "region": (0.0, 0.0), "status": (0.0, 0.0), "notes": (0.0, 0.0), "other": (0.0, 0.0),
}
# The field of a label; the other labels have none.
LABEL_FIELD = {
    "date": "Date", "quantity": "Quantity", "unit_price": "Selling Price", "cost": "Cost Price", "revenue": "Line Total", "discount": "Discount", "tax": "Tax",
    "product": "Item", "category": "Category", "customer": "Customer", "region": "Branch", "mrp": "MRP",
}
# Words of a header that make an id the number of a document.
DOCUMENT_WORDS = ["invoice", "bill", "voucher", "receipt", "order", "txn", "transaction", "document", "doc no", "ref no", "serial no", "serial number", "sr no", "sr. no", "sr number", "बिल", "चालान", "पर्ची", "क्रमांक"]
# Words of headers by rule.
PERCENT_WORDS = ["pct", "percent", "percentage", "gst", "vat"]
AMOUNT_WORDS = ["amount", "amt", "total", "value", "net", "gross"]
RATE_WORDS = ["rate", "price", "sp", "cost", "cp", "mrp"]
PRODUCT_WORDS = ["product", "item", "brand", "style", "model", "sku", "article"]
LATER_DATE_WORDS = ["due", "delivery", "delivered", "ship", "shipped", "dispatch", "eta", "expiry", "expiration", "expected", "promised", "return", "refund", "manufacture", "mfg", "supplier"]
CUSTOMER_WORDS = ["phone", "mobile", "email", "address", "gstin", "gst", "contact", "pincode", "city"]
ITEM_WORDS = ["sku", "hsn", "barcode", "code", "style", "category", "size", "colour", "color", "brand", "unit"]
SLABS_PERCENT, SLABS_FRACTION = [0.0, 5.0, 12.0, 18.0, 28.0], [0.0, 0.05, 0.12, 0.18, 0.28]
# Weights of header and shape, the least header score, and what settles a column.
HEADER_WEIGHT, SHAPE_WEIGHT, LEAST_HEADER, SETTLED, MARGIN = 0.7, 0.3, 0.15, 0.80, 0.05
UNUSED_LABELS = ["currency", "status", "notes"]
# Headers that are recognised and not analysed.
UNUSED_HEADERS = {"currency": ["currency", "ccy", "curr"], "status": ["status", "order status", "payment status", "fulfillment status"], "notes": ["notes", "remarks", "comments", "comment", "remark", "note"]}
BANDS = ((0.9, "high"), (0.65, "medium"))
VERDICT = "decision string, field string, semantic string, confidence double, candidates array<string>"


def _rounded(x: Column) -> Column:
    return F.round(x, 4)


def shape_fit(shapes: DataFrame) -> DataFrame:
    """(column, numeric_ratio, date_ratio) -> (column, label, fit): how well the values agree with each label, from 0 to 1."""
    labels = shapes.sparkSession.createDataFrame([(k, *v) for k, v in EXPECTED_SHAPE.items()], "label string, numeric double, dates double")
    agree = lambda ratio, want: 1 - F.least(F.abs(F.col(ratio) - F.col(want)), F.lit(1.0))
    textual = (F.col("numeric") == 0) & (F.col("dates") == 0)
    fit = F.when(textual, agree("numeric_ratio", "numeric")).otherwise((agree("numeric_ratio", "numeric") + agree("date_ratio", "dates")) / 2)
    return shapes.crossJoin(F.broadcast(labels)).select("column", "label", fit.alias("fit"))  # a fixed table


def blended(header_scores: DataFrame, fits: DataFrame) -> DataFrame:
    """(column, label, score), (column, label, fit) -> (column, label, score, margin, route): each column's best label.

    local: clear enough, or a label that is recognised and not analysed; unknown: no header score above the least; else ask.
    """
    both = header_scores.join(fits, ["column", "label"], "left").withColumn("header", F.greatest("score", F.lit(0.0)))
    both = both.withColumn("blend", HEADER_WEIGHT * F.col("header") + SHAPE_WEIGHT * F.coalesce("fit", F.lit(0.0)))
    order = Window.partitionBy("column").orderBy(F.desc("blend"), "label")
    ranked = both.withColumn("r", F.row_number().over(order)).withColumn("next", F.coalesce(F.lead("blend").over(order), F.lit(0.0))).withColumn("top", F.max("header").over(Window.partitionBy("column")))
    known = F.col("top") > LEAST_HEADER
    margin = F.col("blend") - F.col("next")
    route = F.when(~known, "unknown").when(F.col("label").isin(UNUSED_LABELS), "local").when((F.col("blend") >= SETTLED) & (margin >= MARGIN), "local").otherwise("ask")
    return ranked.filter("r = 1").select("column", F.when(known, F.col("label")).otherwise("other").alias("label"), F.when(known, _rounded(F.col("blend"))).otherwise(0.0).alias("score"), F.when(known, _rounded(margin)).otherwise(0.0).alias("margin"), route.alias("route"))


def field_of(label: Column, header: Column) -> Column:
    """The field of a label; an id is an invoice number only where its header names a document."""
    key = F.lower(F.trim(header))
    document = F.coalesce(*[F.when(F.contains(key, F.lit(w)), True) for w in DOCUMENT_WORDS], F.lit(False))
    low = F.lower(F.trim(label))
    return F.when((low == "id") & document, "Invoice No").otherwise(F.coalesce(*[F.when(low == k, f) for k, f in LABEL_FIELD.items()]))


def label_of(field: Column) -> Column:
    return F.coalesce(*[F.when(field == f, k) for k, f in LABEL_FIELD.items()], F.when(field == "Invoice No", "id"), F.lit("other"))


def classified_headers(headers: DataFrame) -> DataFrame:
    """(ordinal, header) -> (ordinal, header, label, field, score, source): aliases outright, keywords at one half, some recognised and not analysed."""
    g = looked_up(headers)
    key, personal = F.col("key_"), F.col("personal_")
    own = [c for c in headers.columns if c not in ("label", "field", "score", "source")]
    unused = F.coalesce(*[F.when(key.isin(names), label) for label, names in UNUSED_HEADERS.items()])
    exact, fuzzy = F.col("confidence") == "exact", F.col("confidence") == "fuzzy"
    label = F.when(personal, "personal").when(exact, label_of(F.col("field"))).when(unused.isNotNull(), unused).when(fuzzy, label_of(F.col("field"))).otherwise("other")
    field = F.when(exact | (fuzzy & unused.isNull()), F.col("field"))
    score = F.when(exact, 1.0).when(personal, 0.0).when(unused.isNotNull(), 1.0).when(fuzzy, 0.5).otherwise(0.0)
    return g.select(*own, label.alias("label"), field.alias("field"), score.alias("score"), F.when(exact, "dictionary").otherwise("local").alias("source"))


def band(score: Column) -> Column:
    out = F.when(score >= BANDS[0][0], BANDS[0][1])
    return out.when(score >= BANDS[1][0], BANDS[1][1]).otherwise("low")


def resolved(reports: DataFrame, *sheet: str) -> DataFrame:
    """(sheet, ordinal, header, label, field, score, source) -> + band, needs_review: the first column of a sheet that claims a field keeps it."""
    first = F.row_number().over(Window.partitionBy(*sheet, "field").orderBy("ordinal")) == 1
    kept = F.col("field").isNull() | F.col("first")
    out = reports.withColumn("first", first).withColumn("kept", kept)
    out = out.withColumn("band", F.when(F.col("kept"), band(F.col("score"))).otherwise("low")).withColumn("field", F.when(F.col("kept"), F.col("field")))
    review = ~F.col("label").isin([*UNUSED_LABELS, "personal"]) & (F.col("field").isNull() | (F.col("band") == "low"))
    return out.withColumn("needs_review", review).select(*sheet, "ordinal", "header", "label", "field", "score", "band", "source", "needs_review")


def settled(reports: DataFrame, evidence: DataFrame, memory: DataFrame, *sheet: str) -> DataFrame:
    """resolved() reports, (header, decision, field, semantic, confidence), (header, field) -> reports after evidence and memory; each also by sheet where sheet columns are named.

    Only columns that need review change. Personal columns are never mapped; decisive evidence comes before memory, and where
    the two differ the column stays up for review; memory settles what evidence leaves open.
    """
    e = evidence.select(*sheet, F.col("header").alias("e_header"), "decision", F.col("field").alias("e_field"), "semantic", "confidence")
    m = memory.select(*sheet, text.header_key(F.col("header")).alias("m_header"), F.col("field").alias("m_field"))
    reports = reports.withColumns({"e_header": F.col("header"), "m_header": text.header_key(F.col("header"))})
    j = reports.join(e, [*sheet, "e_header"], "left").join(m, [*sheet, "m_header"], "left")
    personal = is_personal(F.col("header")) | (F.col("label") == "personal")
    open_ = F.col("needs_review") & ~personal
    auto = open_ & F.coalesce(F.col("decision") == "auto", F.lit(False))
    conflict = auto & F.col("m_field").isNotNull() & F.col("e_field").isNotNull() & (F.col("m_field") != F.col("e_field"))
    recalled = open_ & ~auto & F.col("m_field").isNotNull()
    return j.select(
        *sheet, "ordinal", "header", F.when(personal, "personal").when(auto, F.coalesce("semantic", "label")).otherwise(F.col("label")).alias("label"),
        F.when(personal, None).when(auto, F.col("e_field")).when(recalled, F.col("m_field")).otherwise(F.col("field")).alias("field"),
        F.when(personal, 0.0).when(auto, _rounded(F.col("confidence"))).when(recalled, 0.95).otherwise(F.col("score")).alias("score"),
        F.when(personal, "low").when(auto, band(F.col("confidence"))).when(recalled, "high").otherwise(F.col("band")).alias("band"),
        F.when(personal, "local").when(auto, "evidence").when(recalled, "memory").otherwise(F.col("source")).alias("source"),
        F.when(personal | recalled, False).when(auto, F.coalesce(conflict, F.lit(False))).otherwise(F.col("needs_review")).alias("needs_review"), F.coalesce(conflict, F.lit(False)).alias("memory_conflict"),
    )


def _verdict(facts: DataFrame, *rules: tuple[Column, str | None, str, Column, list[str]]) -> DataFrame:
    """Facts -> + a verdict: the first rule (condition, field, semantic, confidence, candidates) that holds, else ask."""
    decision = field = semantic = confidence = listed = None
    options = lambda names: F.array(*[F.lit(n) for n in names]).cast("array<string>")
    case = lambda so_far, when, value: F.when(when, value) if so_far is None else so_far.when(when, value)
    for when, name, meaning, sure, names in rules:
        when = F.coalesce(when, F.lit(False))
        auto = meaning != "ask"
        decision, field = case(decision, when, F.lit("auto" if auto else "ask")), case(field, when, F.lit(name))
        semantic, confidence, listed = case(semantic, when, F.lit(meaning if auto else None)), case(confidence, when, _rounded(sure)), case(listed, when, options(names))
    return facts.select("*", decision.otherwise("ask").alias("decision"), field.otherwise(None).cast("string").alias("field"), semantic.otherwise(None).cast("string").alias("semantic"), confidence.otherwise(0.0).alias("confidence"), listed.otherwise(options([])).alias("candidates"))


def rule_of(header: Column) -> Column:
    """Which rule a header calls for: percentage, amount, rate, name, later_date, or none."""
    key, words = F.regexp_replace(text.header_key(header), r"\s+", " "), text.tokens(header)
    has = lambda names: F.arrays_overlap(words, F.array(*[F.lit(n) for n in names]))
    within = lambda names: F.coalesce(*[F.when(F.contains(key, F.lit(n)), True) for n in names], F.lit(False))
    rule = F.when(F.contains(key, F.lit("%")) | has(PERCENT_WORDS), "percentage").when(within(AMOUNT_WORDS), "amount").when(within(RATE_WORDS), "rate")
    return rule.when(has(["name"]) & ~has(PRODUCT_WORDS), "name").when(has(LATER_DATE_WORDS), "later_date")


#: Rules that look at values.
VALUE_RULES = ["percentage", "amount", "rate"]


def column_facts(df: DataFrame, rules: dict[str, str | None], fields: dict[str, str]) -> DataFrame:
    """{column: its rule} -> (column, n, numeric_ratio, n_numbers, slab_share, few, in_range, tested, match_share, n_invoices, repeat_share) of the columns whose rule looks at values.

    Cells are turned to rows (column, cell) and all columns are measured together: one grouped pass for the numbers, one by invoice.
    Few: at most SLAB_MOST different numbers, by a sketch that is exact up to 48 of them, beside an estimate that tells more apart.
    """
    value = lambda f: text.number_of(df, fields[f]) if fields.get(f) in df.columns else F.lit(None).cast("double")
    inv = invoice_of(F.col(f"`{fields['Invoice No']}`")) if fields.get("Invoice No") in df.columns else F.lit(None).cast("string")
    looked = [(c, r) for c, r in rules.items() if r in VALUE_RULES]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(r).alias("rule"), F.col(f"`{c}`").cast("string").alias("cell"), text.number_of(df, c).alias("num")) for c, r in looked]).cast("array<struct<column:string,rule:string,cell:string,num:double>>")
    long = df.select(inv.alias("inv"), value("Quantity").alias("q"), value("Selling Price").alias("p"), value("Line Total").alias("t"), F.explode(cells).alias("c"))
    long = long.select("inv", "q", "p", "t", "c.*")
    amount = F.col("rule") == "amount"
    price, total = F.when(amount, F.col("p")).otherwise(F.col("num")), F.when(amount, F.col("num")).otherwise(F.col("t"))
    tested = (F.col("rule") != "percentage") & (F.col("q") > 0) & (price > 0) & total.isNotNull()
    near = F.abs(F.col("q") * price - total) <= F.greatest(F.abs(total) * TOLERANCE, F.lit(0.01))
    share = lambda x: F.coalesce(F.avg(F.when(F.col("num").isNotNull(), x.cast("double"))), F.lit(0.0))
    numbers = long.groupBy("column").agg(
        F.count("cell").alias("n"), F.coalesce(F.avg(F.when(F.col("cell").isNotNull(), F.col("num").isNotNull().cast("double"))), F.lit(0.0)).alias("numeric_ratio"), F.count("num").alias("n_numbers"),
        F.greatest(share(F.col("num").isin(SLABS_PERCENT)), share(F.col("num").isin(SLABS_FRACTION))).alias("slab_share"), share(F.col("num").between(0, 100)).alias("in_range"),
        ((F.size(F.expr(f"approx_top_k(num, {SLAB_MOST + 1}, 64)")) <= SLAB_MOST) & (F.approx_count_distinct("num") <= 20)).alias("few"),
        F.count_if(F.coalesce(tested, F.lit(False))).alias("tested"), F.avg(F.when(tested, near.cast("double"))).alias("match_share"),
    )
    repeated = repeat_groups(long.filter(F.col("rule").isin("amount", "rate")), "column") if "Invoice No" in fields else None
    if repeated is None:
        return numbers.withColumns({"n_invoices": F.lit(0).cast("long"), "repeat_share": F.lit(None).cast("double")})
    return numbers.join(repeated.select("column", F.col("n").alias("n_invoices"), F.col("share").alias("repeat_share")), "column", "left")


def _judged(headers: DataFrame, facts: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(ordinal, header, others, rule) and column_facts() -> (ordinal, header, verdict).

    A field that one column gets is taken for those after it; only line totals and selling prices can be, and each needs the other
    among `fields`, so what is decided here changes no facts.
    """
    f = headers.join(facts, headers["header"] == facts["column"], "left")
    words = lambda names: F.size(F.array_intersect(F.array_distinct(text.tokens(F.col("others"))), F.array(*[F.lit(n) for n in names])))
    f = f.withColumns({"people": words(CUSTOMER_WORDS), "goods": words(ITEM_WORDS)})
    is_ = lambda rule: F.col("rule") == rule
    taken = lambda field: F.lit(field in fields) & (F.col("header") != F.lit(fields.get(field)))
    none, sure = F.lit(0.0), lambda n: F.least(0.90 + 0.02 * F.col(n), F.lit(0.99))
    enough = is_("percentage") & (F.col("n") >= LEAST_ROWS) & (F.col("numeric_ratio") >= NUMERIC_SHARE)
    slabs = (F.col("slab_share") >= SLAB_SHARE) & F.col("few")
    matches = (F.col("tested") >= LEAST_ROWS) & (F.col("match_share") >= MATCH)
    repeats = (F.col("n_invoices") >= LEAST_INVOICES) & (F.col("repeat_share") >= REPEAT)
    people, goods = F.col("people") > 0, F.col("goods") > 0
    prices = ["MRP", "Cost Price", "Selling Price"]
    v = _verdict(
        f, (enough & slabs, "Tax", "tax", F.col("slab_share"), ["Tax"]), (enough & (F.col("in_range") >= 0.90), None, "ask", none, ["Discount", "Tax"]), (is_("percentage"), None, "ask", none, []),
        (is_("amount") & taken("Line Total"), None, "ask", none, ["Line Total"]), (is_("amount") & (F.col("n") >= LEAST_ROWS) & repeats, None, "invoice_total", F.col("repeat_share"), []),
        (is_("amount") & matches, "Line Total", "revenue", F.col("match_share"), ["Line Total"]), (is_("amount"), None, "ask", none, ["Line Total"]),
        (is_("rate") & taken("Selling Price"), None, "ask", none, prices), (is_("rate") & (F.coalesce("n_numbers", F.lit(0)) < LEAST_ROWS), None, "ask", none, []),
        (is_("rate") & matches, "Selling Price", "unit_price", F.col("match_share"), ["Selling Price"]), (is_("rate") & repeats, None, "ask", none, ["MRP", "Tax", "Discount"]),
        (is_("rate") & slabs, "Tax", "tax", F.col("slab_share"), ["Tax"]), (is_("rate"), None, "ask", none, ["Selling Price", "MRP", "Cost Price"]),
        (is_("name") & people & ~goods, "Customer", "customer", sure("people"), ["Customer"]), (is_("name") & goods & ~people, "Item", "product", sure("goods"), ["Item"]), (is_("name"), None, "ask", none, ["Customer", "Item"]),
        (is_("later_date"), None, "date_like", F.lit(0.95), []),
    )
    for rule, field, names in (("amount", "Line Total", ["Line Total"]), ("rate", "Selling Price", prices)):
        first = F.min(F.when(is_(rule) & (F.col("field") == field), F.col("ordinal"))).over(Window.partitionBy())  # a row a column
        late = F.coalesce(is_(rule) & (F.col("ordinal") > F.col("first")), F.lit(False))
        asked = {"decision": F.lit("ask"), "field": F.lit(None).cast("string"), "semantic": F.lit(None).cast("string"), "confidence": none, "candidates": F.array(*[F.lit(n) for n in names])}
        v = v.withColumn("first", first).withColumn("late", late).withColumns({c: F.when(F.col("late"), x).otherwise(F.col(c)) for c, x in asked.items()})
    return v.select(*[c for c in headers.columns if c not in ("others", "rule")], "decision", "field", "semantic", "confidence", "candidates")


def _verdicts(df: DataFrame, rules: dict[str, Column], fields: dict[str, str]) -> DataFrame:
    spark, names = df.sparkSession, list(rules)
    table = spark.createDataFrame([(i, c, " ".join(h for h in df.columns if h != c)) for i, c in enumerate(names)], "ordinal int, header string, others string")
    told = table.select(*[F.first(F.when(F.col("header") == c, rules[c]), ignorenulls=True).alias(f"r{i}") for i, c in enumerate(names)]).first() if names else ()
    rules = dict(zip(names, told, strict=True))  # a row a header; in the pass over the data they are known
    rule = F.coalesce(*[F.when(F.col("header") == c, F.lit(r)) for c, r in rules.items()], F.lit(None).cast("string"))
    return _judged(table.withColumn("rule", rule), column_facts(df, rules, fields), fields)


def verdicts(df: DataFrame, columns: list[str], fields: dict[str, str]) -> DataFrame:
    """(header, verdict) of each column of df, in two passes over the data however many columns there are. fields: {field: column} of the columns that are mapped."""
    return _verdicts(df, {c: rule_of(F.lit(c)) for c in columns}, fields).drop("ordinal")


def verdict(df: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """The verdict on one column."""
    return verdicts(df, [column], fields).drop("header")


def percentage_rule(df: DataFrame, column: str) -> DataFrame:
    """Tax where the values are tax slabs; a percentage between discount and tax otherwise."""
    return _verdicts(df, {column: F.lit("percentage")}, {})


def amount_rule(df: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """A total of the line or of the invoice."""
    return _verdicts(df, {column: F.lit("amount")}, fields)


def rate_rule(df: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """A price for a piece, a fee of the invoice, or a tax rate."""
    return _verdicts(df, {column: F.lit("rate")}, fields)


def name_rules(headers: DataFrame) -> DataFrame:
    """(sheet, header, others) of headers that are names -> + verdict: a customer's or an item's name, by the words of the sheet's other headers, never by values."""
    none = headers.sparkSession.createDataFrame([], "column string, n long, numeric_ratio double, n_numbers long, slab_share double, in_range double, few boolean, tested long, match_share double, n_invoices long, repeat_share double")
    return _judged(headers.withColumns({"rule": F.lit("name")}), none, {})


def line_total_guard(df: DataFrame, column: str, invoice: str | None) -> DataFrame:
    """One row (verdict, groups): whether a column chosen as line total repeats an invoice's total: reject, warn (one invoice only), ok."""
    if invoice is None or invoice == column:
        return df.sparkSession.createDataFrame([("ok", 0)], "verdict string, groups long")
    facts = invoice_repeat(df, column, invoice)
    out = F.when(F.col("repeats"), "reject").when((F.col("n") == 1) & (F.col("share") == 1), "warn").otherwise("ok")
    return facts.select(out.alias("verdict"), F.col("n").alias("groups"))

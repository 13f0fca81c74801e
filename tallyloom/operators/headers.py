"""From the headers of an export to canonical fields: aliases, then ordered keywords; staged imports, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fields import BY_LABEL, QueryError
from ..functions import text

# Words of headers that hold contact or identity data; such columns are never mapped.
PERSONAL_TOKENS = ["email", "mail", "phone", "mobile", "contact", "aadhaar", "aadhar", "pan", "ssn", "dob", "birth", "tel", "cell"]

# Whole headers (normalised) by field.
ALIASES: dict[str, list[str]] = {
    "Date": ["date", "transaction date", "bill_date", "bill date", "ordered on", "voucher date", "posting date", "invoice date", "order date", "created at", "sale date"],
    "Category": ["category", "item group", "type", "collection", "stock group", "stock category", "section", "menu group", "course", "kitchen group", "department"],
    "Item": ["item", "product_name", "product name", "stock item", "prod", "product code", "particulars", "item name", "item description", "description", "title", "product", "sku"],
    "Quantity": ["qty", "pcs", "qty_sold", "qty sold", "sold", "quantity", "qty.", "billed qty", "lineitem quantity", "quantity-purchased", "units sold"],
    "Selling Price": ["sale price", "price/unit", "selling price", "rate/unit", "rate", "item rate", "lineitem price", "unit price", "price"],
    "MRP": ["mrp"],
    "Cost Price": ["cost price", "purchase_price", "purchase price", "landed cost", "landing cost", "purchase rate", "unit cost", "standard cost"],
    "Line Total": ["gross amount", "row total", "taxable amount", "taxable value", "amount", "net amount", "item amount", "line total", "revenue"],
    "Discount": ["discount amount", "discount"],
    "Tax": ["tax", "cgst+sgst", "gst amount", "net tax amount"],
    "Stock On Hand": ["in stock", "current stock", "closing stock", "balance qty", "available"],
    "Branch": ["outlet", "branch", "store name", "warehouse", "godown", "location"],
    "Payment Mode": ["payment method", "payment mode"],
    "Customer": ["customer_name", "customer name", "customer"],
    "Salesperson": ["sales_person", "salesperson", "salesman"],
    "Brand": ["brand name", "brand"],
    "Size": ["size"],
    "Colour": ["colour", "color"],
    "Invoice No": ["bill no", "order no", "invoice no", "voucher number", "order number"],
}

# Keywords in the order in which they are looked for inside a header; the first that is found decides.
KEYWORDS: list[tuple[str, str]] = [
    ("invoice date", "Date"), ("bill date", "Date"), ("voucher date", "Date"), ("order date", "Date"), ("date", "Date"),
    ("stock", "Stock On Hand"), ("on hand", "Stock On Hand"), ("closing", "Stock On Hand"), ("balance", "Stock On Hand"),
    ("payment", "Payment Mode"), ("salesman", "Salesperson"), ("salesperson", "Salesperson"), ("cashier", "Salesperson"),
    ("customer", "Customer"), ("party", "Customer"), ("branch", "Branch"), ("outlet", "Branch"), ("store", "Branch"), ("godown", "Branch"), ("warehouse", "Branch"),
    ("brand", "Brand"), ("colour", "Colour"), ("color", "Colour"), ("size", "Size"),
    ("invoice", "Invoice No"), ("bill no", "Invoice No"), ("voucher", "Invoice No"), ("order id", "Invoice No"),
    ("discount", "Discount"), ("gst", "Tax"), ("tax", "Tax"),
    ("qty", "Quantity"), ("quant", "Quantity"), ("units", "Quantity"), ("pcs", "Quantity"), ("count", "Quantity"),
    ("purchase", "Cost Price"), ("cogs", "Cost Price"), ("buying", "Cost Price"), ("wholesale", "Cost Price"), ("landing", "Cost Price"), ("cost", "Cost Price"),
    ("taxable", "Line Total"), ("net amount", "Line Total"), ("line total", "Line Total"), ("total", "Line Total"), ("amount", "Line Total"), ("turnover", "Line Total"), ("revenue", "Line Total"),
    ("mrp", "MRP"), ("selling", "Selling Price"), ("unit price", "Selling Price"), ("rate", "Selling Price"), ("price", "Selling Price"),
    ("categ", "Category"), ("dept", "Category"), ("segment", "Category"), ("group", "Category"), ("section", "Category"),
    ("item", "Item"), ("product", "Item"), ("particular", "Item"), ("style", "Item"), ("sku", "Item"), ("goods", "Item"), ("article", "Item"),
]


def header_table(spark: SparkSession, headers: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(headers)), "ordinal int, header string")


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(alias, alias_field) from a dictionary file: JSON lines with phrase and field. Repeated phrases keep the field that comes first in order."""
    rows = spark.read.schema("phrase string, field string").json(path).filter(F.col("field").isin(list(BY_LABEL)))
    return rows.groupBy(text.header_key(F.col("phrase")).alias("alias")).agg(F.min("field").alias("alias_field"))


def known_aliases(spark: SparkSession) -> DataFrame:
    """(alias, alias_field) of ALIASES."""
    return spark.createDataFrame([(a, f) for f, names in ALIASES.items() for a in names], "alias string, alias_field string")


def is_personal(header: Column) -> Column:
    """Whether a header has a word for contact or identity data."""
    return F.arrays_overlap(text.tokens(header), F.array(*[F.lit(t) for t in PERSONAL_TOKENS]))


def looked_up(headers: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """guessed() with what it reads of a header: key_ (normalised) and personal_, which stand once in a plan, below all that asks for them.

    ALIASES go to all tasks: headers that many exports share would else meet in one.
    """
    fixed = known_aliases(headers.sparkSession)
    aliases = F.broadcast(fixed) if aliases is None else aliases.unionByName(fixed.join(aliases, "alias", "left_anti"))
    own = [c for c in headers.columns if c not in ("field", "confidence", "key_", "personal_")]
    read = headers.select(*own, text.header_key(F.col("header")).alias("key_"))
    found = F.coalesce(*[F.when(F.contains("key_", F.lit(k)), F.lit(f)) for k, f in KEYWORDS])
    read = read.select("*", is_personal(F.col("header")).alias("personal_"), found.alias("found_"))
    out = read.join(aliases, F.col("key_") == F.col("alias"), "left")
    field = F.when(F.col("personal_"), None).otherwise(F.coalesce("alias_field", "found_"))
    confidence = F.when(field.isNull(), "none").when(F.col("alias_field").isNotNull(), "exact").otherwise("fuzzy")
    return out.select(*own, "key_", "personal_", field.alias("field"), confidence.alias("confidence"))


def guessed(headers: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(ordinal, header, ...) -> + field, confidence: exact by alias, fuzzy by keyword, or none; personal headers have none.

    aliases: a dictionary of one's own (alias as header_key() makes it, alias_field), which comes before ALIASES.
    """
    return looked_up(headers, aliases).drop("key_", "personal_")


def suggested(headers: DataFrame, *sheet: str) -> DataFrame:
    """guessed(), where only the first column of a field, within its sheet, keeps it."""
    g = guessed(headers)
    first = F.row_number().over(Window.partitionBy(*sheet, "field").orderBy("ordinal")) == 1
    return g.withColumn("keep", F.col("field").isNull() | first).select(*sheet, "ordinal", "header", F.when(F.col("keep"), F.col("field")).alias("field"), F.when(F.col("keep"), F.col("confidence")).otherwise("none").alias("confidence"))


def checked(columns: list[str], mapping: dict[str, str]) -> dict[str, str]:
    """A confirmed mapping, or an error: unknown columns, unknown fields, two columns for one field."""
    targets = [t for t in mapping.values() if t]
    for c, t in mapping.items():
        if c not in columns:
            raise QueryError(f"no column {c}")
        if t and t not in BY_LABEL:
            raise QueryError(f"no field {t}")
    if len(set(targets)) < len(targets):
        raise QueryError("two columns have one field")
    return {c: t for c, t in mapping.items() if t}


def colliding(headers: DataFrame, *sheet: str) -> DataFrame:
    """(sheet, key, n): normalised headers that occur more than once in a sheet."""
    return headers.groupBy(*sheet, text.header_key(F.col("header")).alias("key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def evaluation(predicted: DataFrame) -> DataFrame:
    """(expected, predicted, confidence) -> one row: headers, accuracy over those that aren't ambiguous, and shares by route."""
    clear = F.col("expected") != "ambiguous"
    right = F.coalesce(F.col("predicted"), F.lit("none")) == F.col("expected")
    share = lambda kind: F.avg((F.col("confidence") == kind).cast("double"))
    return predicted.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(clear, right.cast("double"))).alias("accuracy"), share("exact").alias("exact_share"), share("fuzzy").alias("fuzzy_share"), share("none").alias("none_share"), F.count_if(clear & F.col("predicted").isNotNull() & ~right).alias("false_mappings"))


def role_scores(predicted: DataFrame) -> DataFrame:
    """(expected, predicted) -> (role, support, precision, recall) of each field and none; ambiguous headers take no part."""
    clear = predicted.filter("expected <> 'ambiguous'").select("expected", F.coalesce("predicted", F.lit("none")).alias("predicted"))
    sides = clear.select(F.explode(F.array_distinct(F.array("expected", "predicted"))).alias("role"), "expected", "predicted")
    is_, said = F.col("expected") == F.col("role"), F.col("predicted") == F.col("role")
    share = lambda of: F.try_divide(F.count_if(is_ & said).cast("double"), F.count_if(of).cast("double"))
    return sides.groupBy("role").agg(F.count_if(is_).alias("support"), share(said).alias("precision"), share(is_).alias("recall"))


def confusions(predicted: DataFrame, n: int = 10) -> DataFrame:
    """(expected, predicted, n): the most frequent wrong answers."""
    clear = predicted.filter("expected <> 'ambiguous'").select("expected", F.coalesce("predicted", F.lit("none")).alias("predicted")).filter("expected <> predicted")
    return clear.groupBy("expected", "predicted").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "expected", "predicted").limit(n)


def perturbed(headers: DataFrame) -> DataFrame:
    """(ordinal, header) -> (ordinal, kind, header): the spellings of a header that should be read alike; unchanged ones are left out."""
    h = F.col("header")
    wide = F.translate(h, "".join(map(chr, range(0x20, 0x7F))), "\u3000" + "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)))
    kinds = {
        "upper": F.upper(h), "title": F.initcap(h), "pad_spaces": F.concat(F.lit("  "), h, F.lit("  ")), "double_internal_space": F.regexp_replace(h, "^([^ ]*) ", "$1  "), "bom_prefix": F.concat(F.lit("\ufeff"), h),
        "bom_then_space": F.concat(F.lit("\ufeff "), h), "space_then_bom": F.concat(F.lit(" \ufeff"), h), "underscore_for_space": F.replace(h, F.lit(" "), F.lit("_")), "space_for_underscore": F.replace(h, F.lit("_"), F.lit(" ")),
        "hyphen_for_space": F.replace(h, F.lit(" "), F.lit("-")), "trailing_colon": F.concat(h, F.lit(":")), "trailing_dot": F.concat(h, F.lit(".")), "nbsp_for_space": F.replace(h, F.lit(" "), F.lit("\u00a0")),
        "tab_for_space": F.replace(h, F.lit(" "), F.lit("\t")), "fullwidth": wide, "nfd": text.normalised(h, "NFD"),
    }
    some = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds.items()])).alias("p")
    own = [c for c in headers.columns if c not in ("kind", "header")]
    return headers.select(*own, "header", some).filter("p.value <> header").select(*own, "p.kind", F.col("p.value").alias("header"))


def staged(new: DataFrame, known: DataFrame) -> DataFrame:
    """(phrase, target) of imported headers -> + state: present, conflict (several targets, or another than the known one), unmapped, new."""
    per = new.groupBy(text.header_key(F.col("phrase")).alias("phrase")).agg(F.count_distinct("target").alias("k"), F.min("target").alias("target"))
    j = per.join(known.select(F.col("phrase").alias("known_phrase"), F.col("target").alias("known_target")), F.col("phrase") == F.col("known_phrase"), "left")
    state = F.when(F.col("k") > 1, "conflict").when(F.col("target").isNull(), "unmapped").when(F.col("known_target") == F.col("target"), "present").when(F.col("known_target").isNotNull(), "conflict").otherwise("new")
    return j.select("phrase", "target", state.alias("state"))

"""Document fingerprints by I-Match over randomised lexicons, in DataFrame operations alone.

A term's inverse document frequency ln(N / df) over all documents decides whether it is in the lexicon: too common terms
tell nothing, too rare ones are noise. A document keeps its distinct terms of the lexicon, sorted, and hashes of them are its
fingerprint: one of the whole lexicon and one of each randomised sub-lexicon. Sub-lexicons come in FAMILIES nested
chains of falling RATES, so that documents of any length have some in which they keep one or two terms; for two
documents, the share of equal hashes among the sub-lexicons of such a rate follows the share of lexicon terms they share.

Shape of the job: terms are counted exactly, by 64-bit hash, and the lexicon is one row with the band's terms in SLOTS slots. Its
size doesn't grow with the corpus: a term in the band is in at least exp(-IDF_BAND[1]) N of N documents, so there are at most
exp(IDF_BAND[1]), about 2,000, times as many as an average document has different terms. With it a text's fingerprint is an
expression over its own row. Texts are shuffled once, with their hashes, by id and hash, to meet the head of the next one;
nothing else of their size moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, table, written

IDF_BAND = (1.0, 7.6)
FAMILIES = 10
RATES = (2, 8, 32, 128, 512)
#: A rate counts in a comparison if so many of its sub-lexicons meet either document.
LEAST_MET = 3
#: Slots of the lexicon, for a quick look into it; a power of two.
SLOTS = 1 << 16

NO_WORD = r"[^\p{L}\p{N}]+"


def term_hashes(text: Column) -> Column:
    """The distinct terms of a text, as 64-bit hashes: runs of letters and digits, lower-cased."""
    return F.array_remove(F.array_distinct(F.transform(F.split(F.lower(text), NO_WORD), lambda t: F.xxhash64(t))), F.xxhash64(F.lit("")))


def _slot(term: Column) -> Column:
    return term.bitwiseAND(SLOTS - 1)


def lexicon(texts: DataFrame, band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """(text) -> one written row (slots): for each slot, the terms, as hashes, whose inverse document frequency lies in the band."""
    n = texts.count()
    counts = texts.select(F.explode(term_hashes(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    within = F.log(F.lit(float(max(n, 1))) / F.col("df")).between(*band)
    words = counts.filter(within).groupBy(_slot(F.col("term")).alias("slot")).agg(F.sort_array(F.collect_list("term")).alias("terms"))
    every = texts.sparkSession.range(SLOTS).withColumnRenamed("id", "slot").join(words, "slot", "left")  # SLOTS rows, whatever the corpus
    listed = F.sort_array(F.collect_list(F.struct("slot", F.coalesce("terms", F.array().cast("array<bigint>")).alias("terms"))))
    return written(every.agg(F.transform(listed, lambda x: x["terms"]).alias("slots")), "lexicon")


def _kept(terms: Column) -> Column:
    """Those of the terms that the column slots holds."""
    return F.filter(terms, lambda term: F.array_contains(F.get("slots", _slot(term).cast("int")), term))


def _hash32(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.xxhash64(values).bitwiseAND(0xFFFFFFFF).cast("long"))


def _thinned(terms: str, j: int, rate: int) -> Column:
    """Those of the terms that sub-lexicon j of a rate has."""
    return F.filter(terms, lambda t: F.xxhash64(t, F.lit(j)).bitwiseAND(rate - 1) == 0)


def _with_print(df: DataFrame, slots: DataFrame, text: str, whole: str, parts: str, plain: str) -> DataFrame:
    """df with the hashes of a text: whole (null if no term is in the lexicon), parts (for each rate and family, or null), plain (of all terms).

    The lexicon (one row) meets a row when its terms are known and leaves it with the next step: it is far larger than the
    row, and each step that carries it along copies it.
    """
    columns = df.columns
    df = df.withColumn("terms_", F.sort_array(term_hashes(F.col(text)))).crossJoin(F.broadcast(slots))
    df = df.select(*columns, F.xxhash64("terms_", F.lit(-1)).alias(plain), _kept(F.col("terms_")).alias("kept_"))
    df = df.select(*columns, plain, F.when(F.size("kept_") > 0, F.xxhash64("kept_")).alias(whole), "kept_")
    done: list[str] = []
    for k, rate in enumerate(RATES):
        chain = [_thinned(f"f{j}_" if k else "kept_", j, rate).alias(f"f{j}_") for j in range(FAMILIES)]
        new = [f"h{rate}_{j}_" for j in range(FAMILIES)]
        df = df.select(*columns, plain, whole, *done, *chain)
        df = df.select(*columns, plain, whole, *done, *[f"f{j}_" for j in range(FAMILIES)], *[_hash32(F.col(f"f{j}_")).alias(h) for j, h in enumerate(new)])
        done += new
    return df.select(*columns, plain, whole, F.array(*done).alias(parts))


def fingerprint_string(whole: Column, parts: Column, plain: Column) -> Column:
    """Hexadecimal: the whole hash, then the parts, '-' for a sub-lexicon that has no term of the text. plain stands in where no term is in the lexicon."""
    listed = F.concat_ws("", F.transform(parts, lambda v: F.coalesce(F.lower(F.lpad(F.hex(v.cast("long") + F.lit(2**31)), 8, "0")), F.lit("-"))))
    return F.when(whole.isNull(), F.concat(F.lit("="), F.lower(F.hex(plain)))).otherwise(F.concat(F.lower(F.lpad(F.hex(whole), 16, "0")), F.lit(":"), listed))


def likeness(same: Column, a: Column, b: Column) -> Column:
    """1 if all hashes are the same; else the largest share, over rates with LEAST_MET sub-lexicons that meet either document, of those with equal hashes."""
    shares = []
    for r in range(len(RATES)):
        x, y = (F.slice(c, r * FAMILIES + 1, FAMILIES) for c in (a, b))
        met = F.size(F.filter(F.zip_with(x, y, lambda u, v: u.isNotNull() | v.isNotNull()), lambda z: z))
        alike = F.size(F.filter(F.zip_with(x, y, lambda u, v: u == v), lambda z: z))
        shares.append(F.when(met >= LEAST_MET, alike / met).otherwise(F.lit(0.0)))
    return F.when(same, F.lit(1.0)).otherwise(F.coalesce(F.greatest(*shares), F.lit(0.0)))


def fingerprint(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint. A null text is empty; equal texts have equal fingerprints; repeated rows stay."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = _with_print(rows, lexicon(rows.select("text"), band), "text", "whole", "parts", "plain")
    return rows.select("doc_id", fingerprint_string(F.col("whole"), _ints("parts"), F.col("plain")).alias("fingerprint"))


def following(ids: DataFrame, order: list[str]) -> DataFrame:
    """ids with next_<column> for each column of order: those of the next row in that order, the first row's after the last.

    Rows are dealt by ranges and written; within a range the next row is a window away, and a table of the ranges' first rows
    links range to range, so no task sees all rows.
    """
    spark = ids.sparkSession
    ranged = written(ids.repartitionByRange(partitions(spark), *order).withColumn("range", F.spark_partition_id()), "ordered")
    first = ranged.groupBy("range").agg(F.min(F.struct(*order)).alias("first"))
    by_range = Window.orderBy("range")  # a row for each range
    start = F.min_by("first", "range").over(Window.partitionBy())
    links = first.select("range", F.coalesce(F.lead("first").over(by_range), start).alias("link"))
    after = F.lead(F.struct(*order)).over(Window.partitionBy("range").orderBy(*order))
    out = ranged.withColumn("after", after).join(F.broadcast(links), "range").withColumn("after", F.coalesce("after", "link"))
    return out.select(*ids.columns, *[F.col(f"after.{c}").alias(f"next_{c}") for c in order])


def _ints(parts: str) -> Column:
    """32-bit hashes in four bytes."""
    return F.transform(parts, lambda v: (v - F.lit(2**31)).cast("int"))


#: Stands for a null doc_id: before all others.
NO_ID = -(2**63)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    slots = lexicon(docs.select("text"))
    # rows alike in id and text are numbered; one text stands for all of them. This deals the texts, with their hashes, once
    copy = F.row_number().over(Window.partitionBy("doc_id", "h").orderBy("doc_id"))
    texts = _with_print(docs, slots, "text", "w0", "a0", "p0").withColumn("a0", _ints("a0")).withColumn("copy", copy).filter("copy = 1").drop("copy")
    ids = docs.select("doc_id", "h", F.length("text").cast("long").alias("n_chars")).withColumn("copy", copy)
    order = written(following(ids, ["doc_id", "h", "copy"]).withColumn("need", F.floor(F.col("n_chars") / 4).cast("int")), "next")
    nexts = order.select(F.col("doc_id").alias("cur_id"), F.col("h").alias("cur_h"), "n_chars", F.col("next_doc_id").alias("next_id"), "next_h", "need")
    heads = texts.join(nexts, (F.col("doc_id") == F.col("next_id")) & (F.col("h") == F.col("next_h")))
    heads = heads.select("cur_id", "cur_h", "n_chars", "need", F.expr("substring(text, 1, need)").alias("head"), F.col("w0").alias("w2"), F.col("a0").alias("a2"), F.col("p0").alias("p2"))
    both = texts.join(heads, (F.col("doc_id") == F.col("cur_id")) & (F.col("h") == F.col("cur_h")))
    both = both.select("doc_id", "n_chars", F.concat(F.expr("substring(text, 1, n_chars - need)"), "head").alias("edited"), "w0", "a0", "p0", "w2", "a2", "p2")
    both = both.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    both = _with_print(both, slots, "edited", "w1", "a1", "p1").drop("edited").withColumn("a1", _ints("a1"))
    prints = [fingerprint_string(F.col(f"w{k}"), F.col(f"a{k}"), F.col(f"p{k}")) for k in (0, 1)]
    out = both.select("*", prints[0].alias("fingerprint"), prints[1].alias("edited_fingerprint"))
    same = [F.col("w0").eqNullSafe(F.col(f"w{k}")) & (F.col("w0").isNotNull() | (F.col("p0") == F.col(f"p{k}"))) for k in (1, 2)]
    return out.select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(same[0], F.col("a0"), F.col("a1")).alias("near_edited"), likeness(same[1], F.col("a0"), F.col("a2")).alias("near_next"),
    )

"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential variate from a hash of its id and divides it by its quality weight; sorted by that
key within a source, the documents are a weighted sample without replacement. A source whose target is k whole sizes
and a remainder gives k complete epochs, then the documents at the head of the key order until the remainder is filled.

Shape of the job: one scan writes (id, source, size, key). Keys fall into fixed intervals; the sums of an interval are a
map-side aggregate, so only the one interval in which a source's budget ends is ever sorted. The decision is then a
threshold on the key, one row per source, which a plain join brings to the documents: no source is gathered in one
task, whatever its share of the rows, and texts are never shuffled by the sampler.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, words_count, written

WEIGHTS = (1, 2, 3)
CAP = 3
INTERVALS = 4096
#: A plan of at most so many sources (a row of five numbers each) is broadcast; a longer one is joined by shuffle.
SMALL_SOURCES = 50_000
SEED = "mix-1"
JUNK = "#$%&*!|"


def quality_weight(text: Column) -> Column:
    """Share of a text's code points that are no junk marks, 0.1 at least; 1 for an empty or null text."""
    n = F.length(text)
    junk = (n - F.length(F.translate(text, JUNK, ""))) / n
    return F.coalesce(F.greatest(F.lit(0.1), F.lit(1.0) - F.when(n > 0, junk)), F.lit(1.0))


def exponential_key(id_col: Column, size: Column, weight: Column, seed: str = SEED) -> Column:
    """-ln(u) / weight, u in (0, 1) from 52 bits of a digest: small keys come first. Reruns agree."""
    digest = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(id_col.cast("string"), F.lit("")), F.lit("|"), size.cast("string")))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    return -F.log(u) / weight


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size) -> + target. One row a source, so the ordered windows below run over a table of sources.

    Sources in code point order, null last, weigh weights[0], weights[1], ... repeating. Targets share the total size by
    weight; a target above cap times its source's size stops there and the excess is shared again. The fixed point of
    that resharing is min(cap * size, level * weight) with one level for all, which one sort by cap * size / weight finds.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    ranked = (
        sizes.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(order) - 1) % len(weights)).cast("long"))
        .withColumn("most", F.col("source_size") * F.lit(cap))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("stopped", F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("sharing", F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("stopped")) / F.col("sharing"))
    )
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source", "level"))).over(everything)["level"]
    target = F.least(F.col("most").cast("double"), F.coalesce(level * F.col("weight"), F.col("most").cast("double")))
    return ranked.withColumn("target", target).select("source", "source_size", "target")


def sampling_plan(sized: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, size, key) -> one row a source: source_size, target, epochs, cut (largest key of the last, partial epoch; null: none)."""
    interval = F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * INTERVALS)
    sized = sized.withColumn("interval", interval)
    sums = sized.groupBy("source", "interval").agg(F.sum("size").alias("size"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    targets = targets.withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long"))
    targets = targets.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    before = Window.partitionBy("source").orderBy("interval").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    last = (
        sums.alias("s")
        .join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
        .filter((F.col("budget") > 0) & (F.col("before") <= F.col("budget")))
        .groupBy("t.source")
        .agg(F.max(F.struct("interval", "before", "budget")).alias("m"))
        .select("source", "m.*")
    )
    ordered = Window.partitionBy("d.source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        sized.alias("d")
        .join(last.alias("l"), F.col("d.source").eqNullSafe(F.col("l.source")) & (F.col("d.interval") == F.col("l.interval")))
        .withColumn("ahead", F.col("before") + F.coalesce(F.sum("size").over(ordered), F.lit(0)))
        .filter(F.col("ahead") + F.col("size") / 2 <= F.col("budget"))
        .groupBy("d.source")
        .agg(F.max("key").alias("end"))
    )
    # no document of the last interval fits: the cut falls between the intervals
    cuts = last.alias("l").join(ends.alias("e"), F.col("l.source").eqNullSafe(F.col("e.source")), "left")
    cuts = cuts.select("l.source", F.coalesce("end", -F.log(F.lit(1.0) - F.col("interval") / F.lit(float(INTERVALS))) - 1e-12).alias("cut"))
    return targets.alias("t").join(cuts.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source")), "left").select("t.source", "source_size", "target", "epochs", "cut")


def mix_sources(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights=WEIGHTS, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """Every row of docs with mix_size (words), mix_source_size, mix_target, mix_times (0 or more: how often the mix takes it) and mix_taken (words).

    Null and empty texts have size 0 and are taken with their epochs; a null source is a source of its own, the last. Rows
    that repeat an id and a size have equal keys and are taken together. Columns of docs stay as they are, those that begin with
    mix_ are replaced. An empty table gives an empty table.
    """
    docs = docs.drop("mix_size", "mix_source_size", "mix_target", "mix_times", "mix_taken", "mix_key")
    size = words_count(F.col(text))
    sized = docs.withColumn("mix_size", size).withColumn("mix_key", exponential_key(F.col(doc_id), F.col("mix_size"), quality_weight(F.col(text)), seed))
    narrow = written(sized.select(F.col(source).alias("source"), F.col("mix_size").alias("size"), F.col("mix_key").alias("key")), "mix")
    return _taken(sized, sampling_plan(narrow, weights, cap), source)


def _taken(sized: DataFrame, plan: DataFrame, source: str) -> DataFrame:
    plan = plan.select(F.col("source").alias("mix_source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("epochs").alias("mix_epochs"), F.col("cut").alias("mix_cut"))
    times = F.col("mix_epochs") + F.coalesce(F.col("mix_key") <= F.col("mix_cut"), F.lit(False)).cast("long")
    plan = written(plan, "mix-plan")
    if plan.count() <= SMALL_SOURCES:
        plan = F.broadcast(plan)  # a hot source's rows then stay where they are
    out = sized.join(plan, sized[source].eqNullSafe(plan["mix_source"])).withColumn("mix_times", times).withColumn("mix_taken", times * F.col("mix_size"))
    return out.drop("mix_source", "mix_epochs", "mix_cut", "mix_key")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of docs, each row as often as the mix takes it."""
    columns = docs.columns
    out = mix_sources(docs, **options).filter("mix_times > 0")
    return out.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_times").cast("int")))).select(*[F.col(f"`{c}`") for c in columns])


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    size = words_count(F.col("text"))
    sized = docs.withColumn("mix_size", size).withColumn("mix_key", exponential_key(F.col("doc_id"), F.col("mix_size"), quality_weight(F.col("text"))))
    narrow = written(sized.drop("text"), "mix")
    plan = sampling_plan(narrow.select("source", F.col("mix_size").alias("size"), F.col("mix_key").alias("key")))
    out = _taken(narrow, plan, "source")
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), k AS (
  SELECT doc_id, source, size,
    -ln((('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || CAST(size AS VARCHAR)), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
    / coalesce(greatest(0.1::DOUBLE, 1.0::DOUBLE - CASE WHEN length(text) > 0 THEN (length(text) - length(translate(text, '#$%&*!|', '')))::DOUBLE / length(text)::DOUBLE END), 1.0::DOUBLE) AS key
  FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1 AS weight, source_size * 3 AS most,
    CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s
), q AS (
  SELECT *, most::DOUBLE / weight AS ratio FROM r
), l AS (
  SELECT *, (total - coalesce(CAST(sum(most) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))::DOUBLE
    / CAST(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level FROM q
), f AS (
  SELECT level FROM l WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1
), t AS (
  SELECT source, source_size, least(most::DOUBLE, coalesce((SELECT level FROM f) * weight, most::DOUBLE)) AS target FROM l
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t
), a AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, target - epochs * source_size AS budget,
    coalesce(CAST(sum(size) OVER (PARTITION BY k.source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS ahead
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target,
  CAST((epochs + CASE WHEN budget > 0 AND ahead + size / 2.0 <= budget THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM a
"""

"""Approximate nearest neighbours by inner product: cross-polytope hashing with multiprobe and exact reranking.

Vectors are scaled by the largest norm and given one more coordinate that makes them unit vectors; for a query with 0 there,
largest inner product and least angle are then the same. A hash is three rounds of random signs and a fast Hadamard
transform, then the nearest signed axis. Each of TABLES tables deals all vectors by one such hash or two; a query looks into
the axes nearest to it. How many hashes and axes is fitted at every size: the cheapest way whose candidates hold TARGET of the
true neighbours of SAMPLE queries, which one exact scan finds, a way's cost being the vectors it reads and PROBE_COST a bucket.
Where none reaches TARGET short of as many buckets as a table has, all queries meet all vectors in blocks; so do queries
whose buckets hold too few candidates.

Equal vectors are one class, and of a class only the least k + 1 ids can be among a query's k nearest, so copies of one
vector never fill a bucket. Full buckets are cut into blocks. Buckets return a query's best k, and an exact order of these
by (inner product in double precision, id) is the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, trimmed, written

TABLES = 8
ROUNDS = 3
PROBES = (4, 8, 12, 16, 20, 24, 28, 32, 40, 48, 64, 96, 128, 192, 256, 384, 512, 640, 768, 896, 1024, 1280, 1536, 2048, 3072, 4096)
#: What a probe costs beside its candidates, in candidates.
PROBE_COST = 64
SAMPLE = 64
TARGET = 0.96
BLOCK = 8192
SEED = 11


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of rows whose length is a power of two."""
    h, n = 1, x.shape[1]
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x


def rotated(x: np.ndarray, which: int) -> np.ndarray:
    """The pseudo-rotation `which` of rows, padded to a power of two."""
    n = 1 << max(1, (x.shape[1] - 1).bit_length())
    out = np.zeros((len(x), n))
    out[:, : x.shape[1]] = x
    signs = np.random.default_rng([SEED, which]).choice([-1.0, 1.0], (ROUNDS, n))
    for s in signs:
        out = hadamard(out * s)
        out /= np.sqrt(n)
    return out


def unit(vectors: np.ndarray, most: float) -> np.ndarray:
    scaled = vectors / most
    return np.hstack([scaled, np.sqrt(np.maximum(0.0, 1.0 - (scaled**2).sum(axis=1)))[:, None]])


def axes(scores: np.ndarray) -> np.ndarray:
    """Nearest signed axis: 2 * axis, and one more if it is the negative."""
    at = np.abs(scores).argmax(axis=1)
    return 2 * at + (scores[np.arange(len(scores)), at] < 0)


def codes(units: np.ndarray, tables: int, hashes: int) -> np.ndarray:
    """rows x tables bucket numbers."""
    out = np.zeros((len(units), tables), np.int64)
    for t in range(tables):
        for k in range(hashes):
            r = rotated(units, t * 8 + k)
            out[:, t] = out[:, t] * 2 * r.shape[1] + axes(r)
    return out


def probe_order(query: np.ndarray, t: int, hashes: int, most: int) -> np.ndarray:
    """The `most` buckets of table t nearest to a unit query, nearest first."""
    best = None
    for k in range(hashes):
        r = rotated(query[None], t * 8 + k)[0]
        scores = np.stack([r, -r], axis=1).ravel()
        order = np.argsort(-scores, kind="stable")[:most]
        if best is None:
            best = (order, scores[order])
        else:
            # of two falling lists, (i, j) comes after (i + 1) * (j + 1) - 1 others
            many = np.minimum(most // np.arange(1, len(best[0]) + 1), len(order))
            i = np.repeat(np.arange(len(many)), many)
            j = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
            sums = best[1][i] + scores[order[j]]
            at = np.argsort(-sums, kind="stable")[:most]
            best = (best[0][i[at]] * len(scores) + order[j[at]], sums[at])
    return best[0]


def _stack(column) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1) if len(values) else np.zeros((0, 1))


def _classes(vectors: DataFrame, k: int) -> DataFrame:
    """(vec_id, embedding) -> written (c, vector, members): usable vectors, once each, with the least k + 1 ids."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & fine).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0))).withColumn("v", F.xxhash64("vector"))
    order = Window.partitionBy("v", "vector").orderBy("vec_id")
    few = rows.withColumn("rank", F.dense_rank().over(order)).filter(F.col("rank") <= k + 1)  # limited in each task before the shuffle
    return written(few.groupBy("v", "vector").agg(F.array_sort(F.collect_set("vec_id")).alias("members")).select(F.col("members")[0].alias("c"), "vector", "members"), "vectors")


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _fit(classes: DataFrame, queries: DataFrame, n: int, most: float, k: int) -> tuple[int, int] | None:
    """(hashes, probes): the cheapest way that reaches TARGET on a sample of queries; None where all buckets would be probed."""
    sample = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(SAMPLE).toPandas()
    if sample.empty:
        return None
    ids, q = sample["query_id"].to_numpy(), np.stack(sample["vector"].to_numpy())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column(0).to_numpy()
            scores = q @ _stack(batch.column(1)).T
            for i in range(len(q)):
                at = _best(scores[i], c, k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i)), pa.array(c[at]), pa.array(scores[i][at]), batch.column(1).take(pa.array(at))], ["q", "c", "score", "vector"])

    found = classes.select("c", "vector").mapInArrow(trimmed(scan), "q long, c long, score double, vector array<double>")
    first = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))
    near = found.withColumn("r", first).filter(F.col("r") <= k + 1).toPandas()  # SAMPLE * (k + 1) rows
    width = 2 * rotated(np.zeros((1, q.shape[1] + 1)), 0).shape[1]
    cheapest, way = float("inf"), None
    for hashes in (1, 2):
        ranks, reach = [], min(PROBES[-1], width**hashes)
        for i, group in near.groupby("q"):
            group = group[group["c"] != ids[i]].head(k)
            if group.empty:
                continue
            x = np.append(q[i] / np.linalg.norm(q[i]), 0.0)
            order = [{int(b): r for r, b in enumerate(probe_order(x, t, hashes, reach))} for t in range(TABLES)]
            ranks += [min(order[t].get(int(c), reach) for t, c in enumerate(own)) for own in codes(unit(np.stack(group["vector"].to_numpy()), most), TABLES, hashes)]
        ranks = np.array(ranks)
        probes = next((p for p in PROBES if TABLES * p < width**hashes and (not len(ranks) or (ranks < p).mean() >= TARGET)), None)
        if probes is not None and (cost := TABLES * probes * (n / width**hashes + PROBE_COST)) < cheapest:
            cheapest, way = cost, (hashes, probes)
    return way


def _search(k: int):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "scores": pa.array([], pa.list_(pa.float64()))})
        if not candidates.num_rows or not queries.num_rows:
            return empty
        v, q, c = _stack(candidates.column("vector")), _stack(queries.column("vector")), candidates.column("c").to_numpy()
        members, asked = candidates.column("members").to_pylist(), queries.column("query_id").to_numpy()
        ids, scores = [], []
        for at in range(0, len(q), 256):
            block = q[at : at + 256] @ v.T
            for i, row in enumerate(block):
                few = np.argpartition(-row, 2 * k + 2)[: 2 * k + 2] if len(row) > 2 * k + 2 else np.arange(len(row))
                few = np.flatnonzero(row >= row[few].min()) if len(row) > 2 * k + 2 else few
                exact = (v[few] * q[at + i]).sum(axis=1)
                own_ids, own_scores = [], []
                for j in _best(exact, c[few], k + 1):
                    for m in members[few[j]]:
                        if m != asked[at + i]:
                            own_ids.append(m)
                            own_scores.append(exact[j])
                best = _best(np.array(own_scores), np.array(own_ids), k)
                ids.append([own_ids[b] for b in best])
                scores.append([own_scores[b] for b in best])
        return pa.table({"query_id": queries.column("query_id"), "ids": pa.array(ids, pa.list_(pa.int64())), "scores": pa.array(scores, pa.list_(pa.float64()))})

    return run


FOUND = "query_id long, ids array<long>, scores array<double>"


def _all_pairs(classes: DataFrame, queries: DataFrame, n: int, k: int) -> DataFrame:
    """Every query against every vector, by blocks of both."""
    blocks, sides = max(1, -(-n // BLOCK)), max(1, -(-queries.count() // BLOCK))
    left = classes.select("c", "vector", "members", F.pmod(F.xxhash64("c"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(sides - 1))).alias("side"))
    right = queries.select("query_id", "vector", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("query_id"), F.lit(sides)).cast("int").alias("side"))
    return left.groupBy("block", "side").cogroup(right.groupBy("block", "side")).applyInArrow(_search(k), FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    pairs = found.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x")).groupBy("query_id", F.col("x.ids").alias("vec_id")).agg(F.max("x.scores").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def nearest(vectors: DataFrame, *, every: int = 20, k: int = 20) -> DataFrame:
    """(vec_id, embedding) -> query_id, rank, vec_id, score: for each id divisible by `every`, the k nearest others found.

    Vectors that are null, zero, or hold null or non-finite components take no part; nor do vectors of another length than
    most have. Ties go to the smaller id. Rows that repeat an id and a vector count once.
    """
    spark = vectors.sparkSession
    classes = _classes(vectors, k)
    lengths = classes.groupBy(F.size("vector").alias("dim")).agg(F.sum(F.size("members")).alias("n")).orderBy(F.desc("n"), "dim").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim = lengths["dim"]
    classes = classes.filter(F.size("vector") == dim)
    n, square = classes.agg(F.count(F.lit(1)), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))).first()
    most = float(np.sqrt(square)) * (1 + 1e-12)
    rows = vectors.select(F.col("vec_id").cast("long").alias("query_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    queries = written(rows.filter((F.col("query_id") % every == 0) & F.col("vector").isNotNull() & fine & (F.size("vector") == dim)).dropDuplicates(["query_id", "vector"]), "queries")
    way = _fit(classes, queries, n, most, k)
    if way is None:
        return _ranked(_all_pairs(classes, queries, n, k), k)
    hashes, probes = way

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = codes(unit(_stack(batch.column(1)), most), TABLES, hashes)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.tolist(), pa.list_(pa.int64()))], ["c", "vector", "members", "codes"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _stack(batch.column(1))
            q = np.hstack([q / np.linalg.norm(q, axis=1)[:, None], np.zeros((len(q), 1))])
            for i in range(len(q)):
                where = np.concatenate([probe_order(q[i], t, hashes, probes) * TABLES + t for t in range(TABLES)])
                some = pa.array(np.full(len(where), i))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some), pa.array(where)], ["query_id", "vector", "bucket"])

    dealt = classes.mapInArrow(trimmed(deal), "c long, vector array<double>, members array<long>, codes array<long>")
    dealt = dealt.select("c", "vector", "members", F.posexplode("codes").alias("t", "code")).withColumn("bucket", F.col("code") * TABLES + F.col("t"))
    dealt = written(dealt.select("c", "vector", "members", "bucket"), "dealt")
    full = written(dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > BLOCK), "full")  # TABLES * n / BLOCK rows at most: Spark broadcasts it below its threshold
    blocks = F.coalesce(F.ceil(F.col("m") / BLOCK), F.lit(1)).cast("int")
    left = dealt.join(full, "bucket", "left").select("c", "vector", "members", "bucket", F.pmod(F.xxhash64("c"), blocks).cast("int").alias("block"))
    asked = written(queries.mapInArrow(trimmed(ask), "query_id long, vector array<double>, bucket long"), "asked")
    right = asked.join(full, "bucket", "left").select("query_id", "vector", "bucket", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    found = left.groupBy("bucket", "block").cogroup(right.groupBy("bucket", "block")).applyInArrow(_search(k), FOUND)
    ranked = written(_ranked(found, k), "ranked")
    # of all ids, k + 1 tell how many results there are
    full_length = min(k, classes.select(F.explode("members").alias("m")).distinct().limit(k + 1).count() - 1)
    whole = ranked.groupBy("query_id").count().filter(F.col("count") >= full_length).select("query_id")
    short = written(queries.join(whole, "query_id", "left_anti"), "short")
    if full_length < 1 or short.isEmpty():
        return ranked
    topped = _ranked(_all_pairs(classes, short, n, k), k)
    return ranked.join(whole, "query_id", "left_semi").unionByName(topped)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))

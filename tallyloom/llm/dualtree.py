"""Hard negatives by dual-tree search, exact.

Vectors are integers: floor(256 x) of each component; a score is an inner product. One tree of half-spaces, fitted on a bounded
sample, deals all rows to leaves; its shape steers the work and never the result. The rows of a leaf are cut into chunks (by a
hash of the row where a leaf is crowded, so a vector that a third of all rows repeat is spread), and a chunk is halved again and
again into nodes: balls with a centre and a radius over the rows that they hold. Anchors have such a tree of their own.

For an anchors' ball (a, r) and a candidates' ball (b, s) every inner product lies in <a,b> +- (r|b| + s|a| + rs). A pair of nodes
is dropped, with all its anchors at once, where that interval misses what the anchors can still use: for positives scores
from the fifth best known on, for negatives the window from half of a positive's score to 95 % of it, above the third best known.
Pairs are taken level by level: tree nodes, chunks, halves of chunks, down to leaf pairs, which are scored exactly.

Two passes for each search: anchors first meet the chunks of their own leaf, which gives the scores to beat, then all chunks
that the intervals leave. A pass is a merge of chunks with the anchors' chunks that come to them: a task holds one chunk of
candidates and one of anchors, and hands on only scores that beat the known ones; the best of all tasks are found by a ranked
window with a limit before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, table, trimmed, written

#: Rows of a candidates' chunk and of an anchors' chunk, about; rows of the smallest nodes in either.
CHUNK, ANCHORS, LEAF, ANCHOR_LEAF = 2048, 256, 128, 16
#: Rows that the tree is fitted on at most, its levels at most, and sample rows a leaf at least.
FIT, LEVELS, FEWEST = 4096, 8, 16
POSITIVES, NEGATIVES = 5, 3
#: Beyond this, inner products aren't exact in doubles and are taken in Python's integers.
EXACT = float(2**53)
SLACK = 1e-9

_ROUTED = "dim int, leaf int, rid long, vec_id long, label long, anchor boolean, q binary"
_CHUNK = "dim int, leaf int, chunk long, n int, rids array<long>, ids array<long>, labels array<long>, q binary, radius double, norm double, centre array<double>"


def _batch(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


# ---------------------------------------------------------------- the tree of half-spaces


def fit(sample: np.ndarray) -> list[tuple[np.ndarray, float]]:
    """Half-spaces (direction, threshold) in heap order: node k's children are 2k+1 and 2k+2. All levels are full."""
    levels = int(np.clip(np.log2(max(1, len(sample)) / FEWEST), 0, LEVELS))
    planes: list = [None] * (2**levels - 1)
    rows = {0: sample}
    for k in range(len(planes)):
        own = rows.pop(k)
        if len(own) < 2:
            direction, at = np.zeros(sample.shape[1]), 0.0
        else:
            a = own[np.argmax(((own - own.mean(0)) ** 2).sum(1))]
            b = own[np.argmax(((own - a) ** 2).sum(1))]
            direction = b - a
            at = float(np.median(own @ direction))
        planes[k] = (direction, at)
        right = own @ direction > at
        rows[2 * k + 1], rows[2 * k + 2] = own[~right], own[right]
    return planes


def route(q: np.ndarray, planes: list[tuple[np.ndarray, float]]) -> np.ndarray:
    """The leaf, 0 .. 2^levels - 1, of each row."""
    at = np.zeros(len(q), np.int64)
    while len(planes) > at.max(initial=0) and len(q):
        for k in np.unique(at):
            own = at == k
            at[own] = 2 * k + 1 + (q[own] @ planes[k][0] > planes[k][1])
    return at - len(planes)


def quantised(vectors: pa.Array) -> np.ndarray:
    """floor(256 x) of equally long vectors, as whole numbers in doubles; they end at 2^500, so squares are finite."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(flat * 256), -(2.0**500), 2.0**500).reshape(len(vectors), -1)


def _route(batches: Iterator[pa.RecordBatch], planes: list, dim: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t = pa.Table.from_batches([batch])
        dims = np.asarray(t["dim"].to_numpy())
        for d in np.unique(dims):
            own = t.filter(pa.array(dims == d))
            q = quantised(own["vector"].combine_chunks()) if d else np.zeros((own.num_rows, 0))
            leaf = route(q, planes) if d == dim else np.zeros(len(q), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(q), d), pa.int32()), pa.array(leaf, pa.int32()), *(own[c].combine_chunks() for c in ("rid", "vec_id", "label", "anchor")), pa.array([x.tobytes() for x in q], pa.binary())],
                names=["dim", "leaf", "rid", "vec_id", "label", "anchor", "q"],
            )


# ---------------------------------------------------------------- chunks and their nodes


def halves(q: np.ndarray, least: int) -> np.ndarray:
    """An order of the rows in which every node of the chunk's tree (see nodes_of) is a stretch of neighbours."""
    order = np.arange(len(q))

    def split(lo: int, hi: int) -> None:
        if hi - lo <= least:
            return
        own = q[order[lo:hi]]
        a = own[np.argmax(((own - own.mean(0)) ** 2).sum(1))]
        b = own[np.argmax(((own - a) ** 2).sum(1))]
        order[lo:hi] = order[lo:hi][np.argsort(own @ (b - a), kind="stable")]
        mid = (lo + hi) // 2
        split(lo, mid)
        split(mid, hi)

    split(0, len(q))
    return order


def ball(q: np.ndarray) -> tuple[np.ndarray, float]:
    centre = q.mean(0)
    return centre, float(np.sqrt(((q - centre) ** 2).sum(1).max()))


class Nodes:
    """The tree of a chunk: node 0 holds all rows; lo, hi, kids (0: none), centres, radii, norms of the centres."""

    def __init__(self, q: np.ndarray, least: int) -> None:
        self.q, self.lo, self.hi, self.kids = q, [0], [len(q)], []
        for k in range(2 * len(q)):  # appended to while it runs; there are fewer nodes than that
            if k >= len(self.lo):
                break
            lo, hi = self.lo[k], self.hi[k]
            if hi - lo <= least:
                self.kids.append(0)
                continue
            self.kids.append(len(self.lo))
            mid = (lo + hi) // 2
            self.lo += [lo, mid]
            self.hi += [mid, hi]
        balls = [ball(q[lo:hi]) for lo, hi in zip(self.lo, self.hi, strict=True)]
        self.centre, self.radius = np.array([c for c, _ in balls]), np.array([r for _, r in balls])
        self.norm = np.sqrt((self.centre**2).sum(1))


def interval(x: Nodes, i: np.ndarray, y: Nodes, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of pairs of nodes (i of x with j of y), safe against rounding."""
    mid = (x.centre[i] * y.centre[j]).sum(1)
    wide = x.radius[i] * y.norm[j] + y.radius[j] * x.norm[i] + x.radius[i] * y.radius[j]
    wide = wide + SLACK * (np.abs(mid) + wide + x.norm[i] * y.norm[j]) + 1e-6
    return mid - wide, mid + wide


def leaf_pairs(x: Nodes, y: Nodes, useful: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of leaves that are left when useful(nodes of x, least, greatest) has been asked on every level."""
    i, j, out = np.zeros(1, int), np.zeros(1, int), []
    xk, yk = np.array(x.kids), np.array(y.kids)
    while len(i):
        keep = useful(i, *interval(x, i, y, j))
        i, j = i[keep], j[keep]
        done = (xk[i] == 0) & (yk[j] == 0)
        out += zip(i[done].tolist(), j[done].tolist(), strict=True)
        i, j = i[~done], j[~done]
        larger = (yk[j] != 0) & ((xk[i] == 0) | (y.radius[j] >= x.radius[i]))  # the wider ball is opened
        i, j = np.concatenate([i[larger], i[larger], xk[i[~larger]], xk[i[~larger]] + 1]), np.concatenate([yk[j[larger]], yk[j[larger]] + 1, j[~larger], j[~larger]])
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products; beyond what doubles hold, in Python's integers, ending at the limits of long."""
    if not a.size or not b.size or np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.array([[int(v) for v in r] for r in a], object) @ np.array([[int(v) for v in r] for r in b], object).T
    return np.array([[min(max(v, -(2**63)), 2**63 - 1) for v in r] for r in whole], np.int64)


def _pack(rows: pa.Table, least: int) -> pa.Table:
    """Rows of one (dim, leaf, chunk) -> one row, in the order of the chunk's tree."""
    rows = rows.sort_by("rid")  # a rerun gives the same chunk
    dim = rows["dim"][0].as_py()
    q = np.frombuffer(b"".join(rows["q"].to_pylist()), np.float64).reshape(rows.num_rows, dim)
    order = halves(q, least)
    rows, q = rows.take(pa.array(order)), q[order]
    centre, radius = ball(q)
    one = {"dim": ([dim], pa.int32()), "leaf": (rows["leaf"].to_pylist()[:1], pa.int32()), "chunk": (rows["chunk"].to_pylist()[:1], pa.int64()), "n": ([len(q)], pa.int32())}
    one |= {n: ([rows[c].to_pylist()], pa.list_(pa.int64())) for n, c in (("rids", "rid"), ("ids", "vec_id"), ("labels", "label"))}
    small = np.abs(q).max(initial=0) < 2**31
    one |= {"q": ([(q.astype(np.int32) if small else q).tobytes()], pa.binary()), "radius": ([radius], pa.float64()), "norm": ([float(np.sqrt((centre**2).sum()))], pa.float64()), "centre": ([centre.tolist()], pa.list_(pa.float64()))}
    return pa.Table.from_batches([_batch(one)])


def _matrix(q: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(q, np.int32 if len(q) == 4 * n * dim else np.float64).reshape(n, dim).astype(np.float64)


def chunks(routed: DataFrame, size: int, least: int) -> DataFrame:
    """Rows dealt to (dim, leaf, chunk of about `size` rows) -> one row a chunk."""

    def pack(rows: pa.Table) -> pa.Table:
        return _pack(rows, least)

    counts = routed.groupBy("dim", "leaf").agg(F.ceil(F.count("*") / size).alias("pieces"))
    dealt = routed.join(counts, ["dim", "leaf"]).withColumn("chunk", F.pmod(F.xxhash64("rid"), F.col("pieces")))
    return dealt.drop("pieces", "anchor").groupBy("dim", "leaf", "chunk").applyInArrow(pack, _CHUNK)


# ---------------------------------------------------------------- passes

_MET = "a_leaf int, a_chunk long, dim int, slot int, k int, score long, vec_id long, rid long"


def _met(batches: Iterator[pa.RecordBatch], leaf: int, anchor_leaf: int, same: bool) -> Iterator[pa.RecordBatch]:
    """Rows of one chunk of candidates (side 0), then the anchors' chunks that come to it (side 1): what beats the known scores.

    `low` and `high` of an anchors' chunk are its anchors' windows, `want` for each anchor, and `most` how many a window takes.
    """
    here = None
    for batch in batches:
        out: list[np.ndarray] = []
        for r in batch.to_pylist():
            q = _matrix(r["q"], r["n"], r["dim"])
            if r["side"] == 0:
                here = (r["dim"], r["leaf"], r["chunk"], Nodes(q, leaf), *(np.array(r[c], np.int64) for c in ("rids", "ids", "labels")))
                continue
            if here[:3] != (r["dim"], r["leaf"], r["chunk"]):
                continue  # an anchors' chunk without candidates can't be: it holds none of its own leaf's rows
            want = len(r["low"]) // r["n"]
            low, high = (np.array(r[c], np.int64).reshape(r["n"], want) for c in ("low", "high"))
            out += [np.column_stack([np.full(len(x), r["a_leaf"]), np.full(len(x), r["a_chunk"]), np.full(len(x), r["dim"]), x]) for x in _pairs(Nodes(q, anchor_leaf), r, low, high, here, same)]
        rows = np.concatenate(out) if out else np.zeros((0, 8), np.int64)
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(rows[:, i], t) for i, t in enumerate(kinds)], names=[f.split(" ")[0] for f in _MET.split(", ")])


def _pairs(x: Nodes, r: dict, low: np.ndarray, high: np.ndarray, here: tuple, same: bool) -> Iterator[np.ndarray]:
    """(slot, k, score, vec_id, rid) of an anchors' chunk with a candidates' chunk: the `most` best of every window that are not below its low end."""
    *_, y, rids, ids, labels = here
    mine, own = np.array(r["labels"], np.int64), np.array(r["rids"], np.int64)
    least = np.array([low[lo:hi].min() for lo, hi in zip(x.lo, x.hi, strict=True)])
    greatest = np.array([high[lo:hi].max() for lo, hi in zip(x.lo, x.hi, strict=True)])
    pairs = leaf_pairs(x, y, lambda i, lo, hi: (hi >= least[i]) & (lo <= greatest[i]))
    by_leaf: dict[int, list[int]] = {}
    for i, j in pairs:
        by_leaf.setdefault(i, []).append(j)
    for i, js in by_leaf.items():
        a = np.arange(x.lo[i], x.hi[i])
        b = np.concatenate([np.arange(y.lo[j], y.hi[j]) for j in js])
        b = b[np.lexsort((rids[b], ids[b]))]
        s = scores(x.q[a], y.q[b])
        fits = (mine[a][:, None] == labels[b][None, :]) == same
        if same:
            fits &= own[a][:, None] != rids[b][None, :]
        for k in range(low.shape[1]):
            inside = fits & (s >= low[a, k][:, None]) & (s <= high[a, k][:, None])
            for t in np.flatnonzero(inside.any(1)):
                at = np.flatnonzero(inside[t])
                at = at[np.argsort(-s[t, at], kind="stable")[: r["most"]]]  # equal scores: by vec_id, as b is
                yield np.column_stack([np.full(len(at), a[t]), np.full(len(at), k), s[t, at], ids[b[at]], rids[b[at]]])


def _known(anchors: DataFrame, found: DataFrame, most: int) -> DataFrame:
    """Anchors' chunks with the scores to beat: the `most`-th best found so far of each (slot, k), where there are so many; windows of other anchors stay."""
    last = found.filter(F.col("place") == most).groupBy("dim", "a_leaf", "a_chunk").agg(F.collect_list(F.struct("slot", "k", "score")).alias("known"))
    joined = anchors.join(last, ["dim", "a_leaf", "a_chunk"], "left")
    want = F.size("low") / F.col("n")
    raised = F.map_from_entries(F.transform(F.coalesce("known", F.array().cast("array<struct<slot:int,k:int,score:long>>")), lambda x: F.struct((x["slot"] * want + x["k"]).cast("int"), x["score"])))
    return joined.withColumn("low", F.transform("low", lambda x, i: F.greatest(x, F.try_element_at(raised, i)))).drop("known")


def _best(met: DataFrame, most: int) -> DataFrame:
    """The best `most` of each anchor's window by score, smaller vec_id, row; place from 1."""
    w = Window.partitionBy("dim", "a_leaf", "a_chunk", "slot", "k").orderBy(F.desc("score"), "vec_id", "rid")
    return met.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def search(anchors: DataFrame, candidates: DataFrame, most: int, same: bool, leaf: int = LEAF, anchor_leaf: int = ANCHOR_LEAF) -> DataFrame:
    """(dim, a_leaf, a_chunk, slot, k, score, vec_id, rid, place): for window k of each anchor, the first `most` candidates of the same or of other labels.

    anchors: chunks with low and high (of each anchor in turn, its windows). One pass over the chunks of the anchors' own leaves, one over the rest.
    """
    ends = candidates.select("dim", "leaf", "chunk", "radius", "norm", "centre")
    fields = ["dim", "leaf", "chunk", "side", "a_leaf", "a_chunk", "n", "q", "rids", "ids", "labels", "low", "high", "most"]
    none = F.array().cast("array<long>")
    there = candidates.withColumns({"side": F.lit(0), "a_leaf": F.lit(0), "a_chunk": F.lit(0).cast("long"), "low": none, "high": none, "most": F.lit(most)}).select(*fields)

    def meet(own: DataFrame, home: bool) -> DataFrame:
        reach = F.struct(F.array_min("low").alias("least"), F.array_max("high").alias("greatest"))
        narrow = own.select("dim", "a_leaf", "a_chunk", F.col("radius").alias("r"), F.col("norm").alias("m"), F.col("centre").alias("c"), reach.alias("reach"))
        pairs = narrow.withColumn("leaf", F.col("a_leaf")).join(ends, ["dim", "leaf"]) if home else _surviving(narrow, ends)
        mid = F.aggregate(F.zip_with("c", "centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        wide = F.col("r") * F.col("norm") + F.col("radius") * F.col("m") + F.col("r") * F.col("radius")
        wide = wide * (1 + SLACK) + F.abs(mid) * SLACK + F.col("m") * F.col("norm") * SLACK + 1e-6
        pairs = pairs.filter((mid + wide >= F.col("reach.least")) & (mid - wide <= F.col("reach.greatest"))).select("dim", "leaf", "chunk", "a_leaf", "a_chunk")
        guests = pairs.join(own.drop("leaf", "chunk"), ["dim", "a_leaf", "a_chunk"]).withColumns({"side": F.lit(1), "most": F.lit(most)}).select(*fields)
        both = there.unionByName(guests).repartition(partitions(there.sparkSession), "dim", "leaf", "chunk").sortWithinPartitions("dim", "leaf", "chunk", "side", "a_leaf", "a_chunk")
        return written(_best(both.mapInArrow(trimmed(partial(_met, leaf=leaf, anchor_leaf=anchor_leaf, same=same)), _MET), most), "met")

    first = meet(anchors, True)
    rest = meet(_known(anchors, first, most), False)
    return _best(first.drop("place").unionByName(rest.drop("place")), most)


def _surviving(narrow: DataFrame, ends: DataFrame) -> DataFrame:
    """Pairs of anchors' chunks with the chunks of other leaves, leaves that no score can reach left out.

    The leaves of a dimension are one row with 2^LEVELS balls at most, whatever the input: it is joined by dimension.
    """
    mean = ends.groupBy("dim", "leaf").agg(F.max_by("centre", "chunk").alias("c2"))
    far = F.sqrt(F.aggregate(F.zip_with("centre", "c2", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    balls = ends.join(mean, ["dim", "leaf"]).groupBy("dim", "leaf", "c2").agg(F.max(far + F.col("radius")).alias("r2"))
    m2 = F.sqrt(F.aggregate("c2", F.lit(0.0), lambda s, x: s + x * x))
    leaves = balls.groupBy("dim").agg(F.collect_list(F.struct("leaf", "c2", "r2", m2.alias("m2"))).alias("leaves"))
    out = narrow.join(leaves, "dim").withColumn("o", F.explode(F.filter("leaves", lambda x: x["leaf"] != F.col("a_leaf")))).select(narrow["*"], "o.*")
    mid = F.aggregate(F.zip_with("c", "c2", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    wide = F.col("r") * F.col("m2") + F.col("r2") * F.col("m") + F.col("r") * F.col("r2")
    wide = wide * (1 + SLACK) + F.abs(mid) * SLACK + F.col("m") * F.col("m2") * SLACK + 1e-6
    out = out.filter((mid + wide >= F.col("reach.least")) & (mid - wide <= F.col("reach.greatest"))).select("dim", "a_leaf", "a_chunk", "r", "m", "c", "reach", "leaf")
    return out.join(ends, ["dim", "leaf"])


def mined(vectors: DataFrame, *, chunk: int = CHUNK, anchors: int = ANCHORS, leaf: int = LEAF, anchor_leaf: int = ANCHOR_LEAF) -> DataFrame:
    """(vec_id long, label long, vector array of float or double, anchor boolean) -> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    An anchor's positives are its first POSITIVES other rows of its label, its negatives for each the first NEGATIVES rows of other
    labels with 50 * positive_score <= 100 * negative_score <= 95 * positive_score; higher scores first, ties by smaller vec_id. Rows
    with a null in vec_id, label, vector or a component, or a component that isn't finite, take no part. Repeated rows are rows of
    their own; vectors of different lengths never meet; scores beyond long end at its limits. Positives without negatives give no row.
    """
    ok = "vec_id is not null and label is not null and vector is not null and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    rows = vectors.filter(ok).select(F.size("vector").alias("dim"), F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long"), F.col("label").cast("long"), F.coalesce("anchor", F.lit(False)).alias("anchor"), "vector")
    rows = written(rows, "vectors")
    common = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    dim = common["dim"] if common else 0
    sample = rows.filter(F.col("dim") == dim).orderBy(F.xxhash64("vec_id", "label", "rid")).limit(FIT).select("vector").toArrow()["vector"].combine_chunks()
    size = common["count"] if common else 0
    points = quantised(sample)[: max(1, FEWEST * size // chunk)] if size and dim else np.zeros((0, dim))
    routed = written(rows.mapInArrow(trimmed(partial(_route, planes=fit(points), dim=dim)), _ROUTED), "routed")
    candidates = written(chunks(routed, chunk, leaf), "chunks")
    first = written(chunks(routed.filter("anchor"), anchors, anchor_leaf).withColumnsRenamed({"leaf": "a_leaf", "chunk": "a_chunk"}).withColumns({"leaf": F.lit(0), "chunk": F.lit(0).cast("long")}), "anchors")
    all_of = lambda v, times: F.array_repeat(F.lit(v).cast("long"), (F.col("n") * times).cast("int"))
    lowest, highest = -(2**63), 2**63 - 1
    positives = written(search(first.withColumns({"low": all_of(lowest, 1), "high": all_of(highest, 1)}), candidates, POSITIVES, True, leaf, anchor_leaf), "positives")
    place = (F.col("slot") * POSITIVES + F.col("place") - 1).cast("int")
    known = positives.groupBy("dim", "a_leaf", "a_chunk").agg(F.collect_list(F.struct(place.alias("at"), "score")).alias("known"))
    score = F.map_from_entries("known")
    of = lambda f, none: F.transform(F.sequence(F.lit(0), F.col("n") * POSITIVES - 1), lambda i: F.coalesce(F.when(F.try_element_at(score, i) >= 0, f(F.try_element_at(score, i))), F.lit(none).cast("long")))
    # ceil(s / 2) and floor(19 s / 20) in whole numbers; below 0, and where there is no positive, the window ends before it begins
    windows = first.join(known, ["dim", "a_leaf", "a_chunk"]).withColumns({"low": of(lambda s: s - F.shiftright(s, 1), highest), "high": of(lambda s: s - F.floor(s.cast("decimal(20,0)") / 20).cast("long") - (s % 20 > 0).cast("long"), lowest)}).drop("known")
    negatives = search(windows, candidates, NEGATIVES, False, leaf, anchor_leaf)
    p = positives.select("dim", "a_leaf", "a_chunk", "slot", (F.col("place") - 1).alias("k"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    n = negatives.select("dim", "a_leaf", "a_chunk", "slot", "k", F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = first.select("dim", "a_leaf", "a_chunk", F.posexplode("ids").alias("slot", "anchor_id"))
    keys = ["dim", "a_leaf", "a_chunk", "slot"]
    return n.join(p, [*keys, "k"]).join(names, keys).select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(rows.select("vec_id", label.alias("label"), F.col("embedding").alias("vector"), (F.col("vec_id") % 50 == 0).alias("anchor")))


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""

"""N-gram Jaccard join in metric space.

Jaccard distance is a metric, so a pivot's distances bound those between other documents: documents go to their nearest
pivot's Voronoi region and, as a pair within eps can only part where a document is nearly as close to another pivot, also to
each region whose pivot is at most 2 eps further. Regions join recursively with new pivots, the smallest ones exactly.
The join does this twice, in a coarse metric space and in the exact one.

1. Documents that share nothing lie at distance 1 of each other and of every pivot, so no pivot tells them apart. They
   are dealt first, exactly: of a document's shingles, in an order common to all documents, the first
   n - ceil(p n) + 1 (p: the least similarity that links) must meet those of every document that it links with. The order puts shingles of rare words
   first, by a count of words over all documents in a table of fixed size, so that mostly kin meet; and sizes that link
   are within p of each other, so documents meet by shingle and step of size.
2. Those that meet join by pivots, regions and windows in the space of histograms of their sets (shingles hashed to bins), whose
   Jaccard distance is a metric too and never exceeds that of the sets: a pair that links is never cleared. What lies within eps there are
   candidates; their components are families.
3. A family joins by pivots, regions and windows in the space of its sets, exactly.

In both spaces a group that fits in a task does all this in numpy in that task. A larger one is first split by pivots across
tasks: of a region whose members all link with its pivot nothing is left to compare. What pivots can't split (documents all
alike or all far apart) is joined in blocks, without the pairs of blocks whose documents are already known to be connected.

Documents with equal sets (told by 64 bits) are one class throughout: copies cost one row. Only links that connect are kept, as stars.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, table, trimmed, written
from .graph import components

#: op5's words a shingle, and its links: 100 * intersection >= PERCENT * union.
SHINGLE = 4
PERCENT = 85
SLOT_BITS = 18
#: A region of at most so many shingles joins in one task (8 bytes each).
REGION_SHINGLES = 2_000_000
PIVOTS = 16
LEVELS = 2
#: Pivots don't split a region of which one of their regions holds more than this share.
WHOLE = 0.8
#: Documents up to which a region is joined pair by pair.
SMALL_REGION = 3
#: Rows up to which a group of documents that meet joins in one task.
GROUP = 1024
#: The same for its regions, in 8 bytes of histograms.
GROUP_MASS = 1 << 16
#: Class lists up to this length (16 bytes each) are broadcast to fetch sets.
MOST_BROADCAST = 2_000_000
CHUNK_BYTES = 1 << 19
#: (least shingles, bins) of a set's histogram: enough bins that sets which share little differ by more than links may.
BINS = ((2500, 2048), (500, 256), (0, 64))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _RANDOM.integers(1, 2**63, 4096, dtype=np.uint64) | np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, A-Z lower-cased, and where each text's words begin (one more at the end)."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(d) + 1 for d in data])])
    raw = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    space = _SPACE[raw]
    begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    place = np.arange(len(raw)) - np.repeat(np.concatenate([[0], begins]), np.diff(np.concatenate([[0], begins, [len(raw)]])))
    values = _BYTE[_LOWER[raw]] * _PLACE[place & 4095] + (place >> 12).astype(np.uint64)
    values[space] = 0
    return _mixed(np.add.reduceat(values, begins)), np.searchsorted(begins, starts)


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of `size` words, in order; fewer words are one run."""
    if not len(words):
        return words
    n = min(size, len(words))
    h = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k])
    return h


def chunks(column: pa.Array) -> Iterator[tuple[int, list]]:
    """(offset, texts) of pieces of a column that hold CHUNK_BYTES or one text."""
    for at in range(0, len(column), 256):
        texts = column.slice(at, 256).to_pylist()
        start, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size >= CHUNK_BYTES or i + 1 == len(texts):
                yield at + start, texts[start : i + 1]
                start, size = i + 1, 0


def class_of(own: np.ndarray) -> int:
    """The class of a set: a 64-bit digest of its sorted members."""
    return xxhash.xxh3_64_intdigest(own.tobytes()) - 2**63


def histogram(own: np.ndarray) -> bytes:
    bins = next(b for n, b in BINS if len(own) >= n)
    while len(own) > bins << 14:  # counts stay far below 65,536
        bins *= 2
    return np.minimum(np.bincount((own >> np.uint64(20)).astype(np.int64) & (bins - 1), minlength=bins), 65535).astype("<u2").tobytes()


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def _classes(docs: DataFrame, size: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, text) -> written (doc_id, n, c, bins), c and bins null where n is 0; and the rarity of each slot of word hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << SLOT_BITS, np.int64)
        names = ["doc_id", "n", "c", "bins", "counts"]
        empty = pa.list_(pa.int64())
        for batch in batches:
            ids = batch.column(0)
            for at, texts in chunks(batch.column(1)):
                words, ends = word_hashes(texts)
                seen += np.bincount((words >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=len(seen))
                sets = [np.unique(shingles(words[a:b], size)) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(texts)), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()), pa.array([histogram(s) if len(s) else None for s in sets], pa.binary()), pa.nulls(len(texts), empty)], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([seen.tolist()], empty)], names)

    out = written(docs.mapInArrow(trimmed(run), "doc_id long, n long, c long, bins binary, counts array<long>"), "classes")
    slots = out.filter("counts is not null").select(F.posexplode("counts")).filter("col > 0").groupBy("pos").agg(F.sum("col").alias("n")).toPandas()  # 2 ** SLOT_BITS rows at most
    counts = np.zeros(1 << SLOT_BITS)
    counts[slots["pos"]] = slots["n"]
    return out.filter("counts is null").select("doc_id", "n", "c", "bins"), np.round(16 * np.log2(counts + 1)).astype(np.int32)


def _prefixes(docs: DataFrame, rarity: np.ndarray, size: int, percent: int) -> DataFrame:
    """(doc_id, text) -> written (h, c): the shingles by which a class meets those that it links with."""
    shared = docs.sparkSession.sparkContext.broadcast(rarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, known = shared.value, set()
        for batch in batches:
            for _, texts in chunks(batch.column(1)):
                words, ends = word_hashes(texts)
                slot = common[(words >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
                hs, cs = [], []
                for a, b in zip(ends[:-1], ends[1:], strict=True):
                    if a == b:
                        continue
                    h = shingles(words[a:b], size)
                    own, first = np.unique(h, return_index=True)
                    c = class_of(own)
                    if c in known:
                        continue
                    if len(known) < 200_000:
                        known.add(c)
                    k = min(size, b - a)
                    sums = np.concatenate([[0], np.cumsum(slot[a:b])])
                    weight = (sums[k:] - sums[:-k])[first]
                    take = prefix_length(len(own), percent)
                    hs.append(own[np.lexsort((own, weight))[:take]])
                    cs.append(np.full(take, c, np.int64))
                if hs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.concatenate(cs))], ["h", "c"])

    return written(docs.mapInArrow(trimmed(run), "h long, c long"), "prefixes")


def size_step(percent: int) -> float:
    """The logarithm of the ratio of sizes from one step to the next: sizes that link are one step apart at most."""
    return max(1e-9, math.log(100 / percent)) * (1 + 1e-9)


def _stars_of(met: DataFrame, percent: int) -> DataFrame:
    """(h, s, c, bins), rows of an (h, s) together -> (a, b): each class and one that stands for those it may link with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple[int, int]] = []

        def close() -> None:
            if len(held) > 1:
                region = Histograms([x[3] for x in held], percent)
                region.join(np.arange(len(held)))
                root = region.roots(np.arange(len(held)))
                out.extend((held[i][2], held[r][2]) for i, r in enumerate(root.tolist()) if r != i)
            held.clear()

        def flush() -> pa.RecordBatch:
            a, b = zip(*out, strict=True) if out else ((), ())
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                for row in zip(*(some.column(x).to_pylist() for x in ("h", "s", "c", "bins")), strict=True):
                    if held and held[0][:2] != row[:2]:
                        close()
                    held.append(row)
            yield flush()
        close()
        yield flush()

    return met.mapInArrow(trimmed(run), "a long, b long")


def _folded(met: DataFrame, percent: int) -> DataFrame:
    """(h, s, c, bins) -> (family, c, n, own): histograms of a step with the same number of bins."""
    step = size_step(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = [math.exp(s * step) for s in batch.column(1).to_pylist()]
            widths = [next(b for n, b in BINS if x >= n + 1e-6 or not n) for x in least]
            own = [np.frombuffer(b, "<u2").astype("<u4").reshape(-1, w).sum(axis=0).astype("<u4").tobytes() for b, w in zip(batch.column(3).to_pylist(), widths, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(x) // 8 for x in own], pa.int64()), pa.array(own, pa.binary())], ["family", "c", "n", "own"])

    return met.select(F.xxhash64("h", "s").alias("family"), "s", "c", "bins").mapInArrow(trimmed(run), "family long, c long, n long, own binary")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(doc_id, text), (doc_id, c, family) -> (family, c, n, own): each class's sorted set as bytes."""
    wanted = F.broadcast(wanted) if wanted.count() <= MOST_BROADCAST else wanted
    names = ["family", "c", "n", "own"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, families = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for at, texts in chunks(batch.column(0)):
                words, ends = word_hashes(texts)
                rows = []
                for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True), at):
                    own = np.unique(shingles(words[a:b], size))
                    if len(own) and class_of(own) == classes[i]:  # another row can repeat the id
                        rows.append((families[i], classes[i], len(own), own.tobytes()))
                columns = list(zip(*rows, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names)

    return docs.join(wanted, "doc_id").select("text", "c", "family").mapInArrow(trimmed(run), "family long, c long, n long, own binary")


class Region:
    """Documents of a region in a metric space, and the components found so far."""

    sizes: np.ndarray
    #: Regions that pivots made, and documents that windows put into further ones.
    regions = windows = 0

    def __init__(self, count: int, percent: int):
        self.percent, self.up = percent, np.arange(count)

    def meets(self, p: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes of intersection and union of document p with each of ids."""
        raise NotImplementedError

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return int(i)

    def roots(self, ids: np.ndarray) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return self.up[ids]
            self.up = up

    def link(self, p: int, others: np.ndarray) -> None:
        for r in np.unique(self.roots(np.append(others, p))):
            a, b = self.root(p), self.root(int(r))
            self.up[max(a, b)] = min(a, b)

    def pairs(self, ids: np.ndarray, sides: np.ndarray | None = None) -> None:
        """Exactly: each pair of ids (of different sides, if given) that isn't connected yet."""
        ids = ids[np.argsort(self.sizes[ids], kind="stable")]
        for k, p in enumerate(ids[:-1]):
            rest = ids[k + 1 :]
            rest = rest[100 * self.sizes[p] >= self.percent * self.sizes[rest]]
            if sides is not None:
                rest = rest[sides[rest] != sides[p]]
            rest = rest[self.roots(rest) != self.root(int(p))] if len(rest) else rest
            if len(rest):
                both, union = self.meets(int(p), rest)
                if (near := 100 * both >= self.percent * union).any():
                    self.link(int(p), rest[near])

    def join(self, ids: np.ndarray, seed: int = 0) -> None:
        """Pivots, Voronoi regions with windows of 2 eps, recursion; pairs where that no longer splits."""
        if len(ids) <= SMALL_REGION:
            self.pairs(ids)
            return
        order = np.random.default_rng(seed).permutation(len(ids))[: max(2, min(PIVOTS, math.isqrt(len(ids))))]
        distance = np.empty((len(order), len(ids)))
        linked = np.empty((len(order), len(ids)), bool)
        for row, k in enumerate(order):
            both, union = self.meets(int(ids[k]), ids)
            distance[row], linked[row] = 1 - both / union, 100 * both >= self.percent * union
            self.link(int(ids[k]), ids[linked[row]])
        if len(np.unique(self.roots(ids))) == 1:
            return
        window = 2 * (1 - self.percent / 100) + 1e-9
        inside = distance <= distance.min(axis=0) + window
        self.regions += len(order)
        self.windows += int(inside.sum()) - len(ids)
        # where all link with the pivot nothing is left to compare
        parts = {k: ids[part] for k, part in enumerate(inside) if part.sum() > 1 and (part & ~linked[k]).any()}
        if parts and max(map(len, parts.values())) > WHOLE * len(ids):
            self.pairs(ids)
            return
        for k, part in parts.items():
            self.join(part, seed + k + 1)


class Sets(Region):
    """The space of sets of shingles, compactly numbered."""

    def __init__(self, own: list[bytes], percent: int = PERCENT):
        super().__init__(len(own), percent)
        sets = [np.frombuffer(x, np.uint64) for x in own]
        self.sizes = np.array([len(s) for s in sets], np.int64)
        _, tokens = np.unique(np.concatenate(sets), return_inverse=True) if sets else (None, np.zeros(0, np.int64))
        self.width = int(tokens.max(initial=-1)) + 1
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        self.tokens = tokens

    def meets(self, p: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mark = np.zeros(self.width, bool)
        mark[self.tokens[self.at[p] : self.at[p + 1]]] = True
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        where = np.arange(ends[-1]) + np.repeat(self.at[ids] - (ends - sizes), sizes)
        both = np.add.reduceat(mark[self.tokens[where]].astype(np.int64), ends - sizes)
        return both, sizes + self.sizes[p] - both


class Histograms(Region):
    """The space of histograms, folded to the fewest bins among them."""

    def __init__(self, own: list[bytes], percent: int = PERCENT, kind: str = "<u2"):
        super().__init__(len(own), percent)
        width = min(map(len, own)) // np.dtype(kind).itemsize
        self.table = np.stack([np.frombuffer(b, kind).astype(np.int32).reshape(-1, width).sum(axis=0) for b in own])
        self.sizes = self.table.sum(axis=1, dtype=np.int64)

    def meets(self, p: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = np.minimum(self.table[ids], self.table[p]).sum(axis=1, dtype=np.int64)
        return both, self.sizes[ids] + self.sizes[p] - both


def wide_histograms(own: list[bytes], percent: int) -> Histograms:
    return Histograms(own, percent, "<u4")


def _load(group: pa.Table, percent: int, space: Callable) -> tuple[np.ndarray, Region]:
    classes = np.array(group.column("c").to_pylist(), np.int64)
    _, first = np.unique(classes, return_index=True)
    own = group.column("own").to_pylist()
    return classes[first], space([own[i] for i in first], percent)


def _stars(classes: np.ndarray, region: Region) -> pa.Table:
    roots = region.roots(np.arange(len(classes)))
    some = roots != np.arange(len(classes))
    return pa.table({"a": classes[some], "b": classes[roots[some]]})


def _join_group(percent: int, space: Callable):
    def run(group: pa.Table) -> pa.Table:
        classes, region = _load(group, percent, space)
        # links with the region's pivot are known
        of_pivot = np.unique(np.array(group.column("c").to_pylist(), np.int64)[np.array(group.column("star").to_pylist(), bool)])
        if len(of_pivot):
            star = np.searchsorted(classes, of_pivot)
            region.link(int(star[0]), star[1:])
        region.join(np.arange(len(classes)))
        return _stars(classes, region)

    return run


def _join_blocks(percent: int, space: Callable):
    """Two blocks, or one with itself: only pairs across the sides, of different known components."""

    def run(group: pa.Table) -> pa.Table:
        classes, region = _load(group, percent, space)
        side = dict(zip(group.column("c").to_pylist(), group.column("side").to_pylist(), strict=True))
        sides = np.array([side[int(c)] for c in classes])
        region.pairs(np.arange(len(classes)), sides if len(np.unique(sides)) > 1 else None)
        return _stars(classes, region)

    return run


def _assign(percent: int, space: Callable):
    """Members of a region and its pivots: (family, a, b, linked, inside): links to pivots, and the Voronoi regions that each member belongs to."""
    names, types = ["family", "a", "b", "linked", "inside"], [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]

    def run(members: pa.Table, pivots: pa.Table) -> pa.Table:
        if not members.num_rows or not pivots.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, types, strict=True)})
        mine, own = np.array(members.column("c").to_pylist(), np.int64), members.column("own").to_pylist()
        order = np.argsort(np.array(pivots.column("c").to_pylist(), np.int64))
        heads, theirs = np.array(pivots.column("c").to_pylist(), np.int64)[order], pivots.column("own").to_pylist()
        region = space(own + [theirs[k] for k in order], percent)
        ids = np.arange(len(mine))
        distance, linked = np.empty((len(heads), len(mine))), np.empty((len(heads), len(mine)), bool)
        for k in range(len(heads)):
            both, union = region.meets(len(mine) + k, ids)
            distance[k], linked[k] = 1 - both / union, 100 * both >= percent * union
        inside = distance <= distance.min(axis=0) + 2 * (1 - percent / 100) + 1e-9
        head, member = np.nonzero(inside | linked)
        columns = np.full(len(head), members.column("family")[0].as_py()), mine[member], heads[head], linked[head, member], inside[head, member]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, types, strict=True)})

    return run


def _united(group: pa.Table) -> pa.Table:
    """The different lists of pivots that members of a family link with -> (family, b, root): pivots that members connect have one root."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for heads in group.column("heads").to_pylist():
        for h in heads:
            a, b = root(heads[0]), root(h)
            up[max(a, b)] = min(a, b)
    heads = list(up)
    return pa.table({"family": pa.array([group.column("family")[0].as_py()] * len(heads), pa.int64()), "b": pa.array(heads, pa.int64()), "root": pa.array(list(map(root, heads)), pa.int64())})


def _split(rows: DataFrame, sizes: DataFrame, limit: int, level: int, percent: int, space: Callable) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Large regions (family, c, n, own) -> links to pivots (family, a, b); (family, region, c, star) by Voronoi regions with windows; the families that had a pivot, and those of them that pivots don't split."""
    big = rows.select("family", "c", "own").join(sizes, "family")
    salts = F.ceil(F.col("mass") / F.lit(limit / 2)).cast("int")
    pivots = big.filter(F.pmod(F.xxhash64("c", F.lit(level)), F.col("members")) < PIVOTS)
    pivots = written(pivots.select("family", "c", "own", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")), "pivots")
    members = big.select("family", "c", "own", F.pmod(F.xxhash64("c", F.lit(level + 100)), salts).cast("int").alias("salt"))
    found = members.groupBy("family", "salt").cogroup(pivots.groupBy("family", "salt")).applyInArrow(_assign(percent, space), "family long, a long, b long, linked boolean, inside boolean")
    found = written(found, "voronoi")
    inside = found.filter("inside")
    # a region whose members all link with its pivot is done
    of = inside.groupBy("family", "b").agg(F.min("linked").alias("done"), F.count(F.lit(1)).alias("m"))
    open_ = written(of.filter("not done").join(sizes.select("family", "members"), "family"), "open")
    whole = open_.filter(F.col("m") > WHOLE * F.col("members")).select("family").distinct()
    parts = open_.join(whole, "family", "left_anti").select("family", "b")
    regions = inside.join(parts, ["family", "b"]).select("family", F.xxhash64("family", "b").alias("region"), F.col("a").alias("c"), F.col("linked").alias("star"))
    return found.filter("linked").select("family", "a", "b"), regions, found.select("family").distinct(), whole


def _blocks(sets: DataFrame, linked: DataFrame, limit: int, percent: int, space: Callable) -> DataFrame:
    """Regions that pivots don't split: pairs of blocks, but for two blocks of one known component. linked: their members' links to pivots."""
    # pivots are few, and so are the different lists of them that a family's members link with (2 ** PIVOTS at most, a handful as a rule)
    heads = linked.groupBy("family", "a").agg(F.sort_array(F.collect_set("b")).alias("heads"))
    roots = heads.select("family", "heads").distinct().groupBy("family").applyInArrow(_united, "family long, b long, root long")
    known = linked.join(roots, ["family", "b"]).groupBy("family", F.col("a").alias("c")).agg(F.min("root").alias("root"))
    rows = written(sets.join(known, ["family", "c"], "left").withColumn("component", F.coalesce("root", "c")).drop("root"), "blocks")
    # a component of at least a block has blocks of its own; the others share blocks
    of = rows.groupBy("family", "component").agg(F.sum("n").alias("mass")).filter(F.col("mass") >= limit / 2)
    rows = rows.join(of, ["family", "component"], "left").withColumn("own_blocks", F.when(F.col("mass").isNotNull(), F.col("component")).otherwise(F.lit(None)))
    others = rows.filter("own_blocks is null").groupBy("family").agg(F.sum("n").alias("whole"))
    rows = rows.join(others, "family", "left")
    mass = F.coalesce("mass", "whole")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("c", F.lit(55)), F.ceil(mass / F.lit(limit / 2))).cast("int"))
    names = rows.groupBy("family", "own_blocks", "block").agg(F.count(F.lit(1)).alias("k")).withColumn("name", F.xxhash64("own_blocks", "block"))
    pairs = names.alias("x").join(names.alias("y"), (F.col("x.family") == F.col("y.family")) & (F.col("x.name") <= F.col("y.name")) & ~(F.col("x.own_blocks").isNotNull() & (F.coalesce(F.col("x.own_blocks") == F.col("y.own_blocks"), F.lit(False)))))
    pairs = pairs.select(F.col("x.family").alias("family"), F.col("x.name").alias("x"), F.col("y.name").alias("y"))
    sides = pairs.select("family", "x", "y", F.col("x").alias("name"), F.lit(0).alias("side")).unionByName(pairs.filter("x <> y").select("family", "x", "y", F.col("y").alias("name"), F.lit(1).alias("side")))
    dealt = rows.withColumn("name", F.xxhash64("own_blocks", "block")).select("family", "c", "own", "name").join(sides, ["family", "name"])
    return dealt.groupBy("family", "x", "y").applyInArrow(_join_blocks(percent, space), "a long, b long")


def _regions(rows: DataFrame, limit: int, percent: int, space: Callable) -> DataFrame:
    """(family, c, n, own) -> (a, b): links within families, joined by pivots and regions; n is what a row weighs against limit."""
    rows = rows.withColumn("star", F.lit(False))
    found: DataFrame | None = None

    def add(more: DataFrame) -> None:
        nonlocal found
        found = more if found is None else found.unionByName(more)

    rest: DataFrame | None = None
    known: DataFrame | None = None
    for level in range(LEVELS + 1):
        sizes = rows.groupBy("family").agg(F.sum("n").alias("mass"), F.count(F.lit(1)).alias("members"))
        large = written(sizes.filter(F.col("mass") > limit), "large")
        small = rows.join(large.select("family"), "family", "left_anti")
        add(written(small.groupBy("family").applyInArrow(_join_group(percent, space), "a long, b long"), "links"))
        if large.isEmpty():
            break
        big = rows.join(large.select("family"), "family", "left_semi")
        stuck = large
        if level < LEVELS:
            linked, regions, split, whole = _split(big, large, limit, level, percent, space)
            add(linked.filter("a <> b").select("a", "b"))
            stuck = large.join(whole, "family", "left_semi")
            dealt = big.drop("star").join(regions, ["family", "c"]).select(F.col("region").alias("family"), "c", "n", "own", "star")
            # a large region without a pivot keeps its name and waits for the next level
            kept = big.join(split, "family", "left_anti").select("family", "c", "n", "own", "star")
            rows = written(dealt.unionByName(kept), "regions")
            if not whole.isEmpty():
                of_stuck = linked.join(whole, "family", "left_semi")
                known = of_stuck if known is None else known.unionByName(of_stuck)
        left = big.drop("star").join(stuck.select("family"), "family", "left_semi")
        rest = left if rest is None else rest.unionByName(left)
        if level < LEVELS and rows.isEmpty():
            break
    if rest is not None:
        if known is None:
            known = rows.sparkSession.createDataFrame([], "family long, a long, b long")
        add(written(_blocks(rest, known, limit, percent, space), "links"))
    return found


def _families(docs: DataFrame, classes: DataFrame, rarity: np.ndarray, size: int, percent: int) -> DataFrame:
    """(doc_id, text) and their classes -> written (c, family): classes that may link are in one family."""
    prefixes = _prefixes(docs, rarity, size, percent)
    least = prefixes.groupBy("h").agg(F.min("c").alias("p"), F.max("c").alias("q")).filter("p < q").select("h")
    one = classes.filter("c is not null").groupBy("c").agg(F.first("n").alias("n"))
    # sizes that link are in one step or in neighbouring ones: a class meets those of its step and of the one above
    home = F.floor(F.log("n") / F.lit(size_step(percent))).cast("int")
    met = prefixes.join(least, "h").distinct().join(one, "c").select("h", "c", home.alias("home"))
    met = met.select("h", "c", "home", F.explode(F.array("home", F.col("home") - 1)).alias("s"))
    # the shingles of one passage bring the same documents together: one of them is enough
    who = F.xxhash64("c", F.lit(1)), F.xxhash64("c", F.lit(2))
    groups = met.groupBy("h", "s").agg(F.count(F.lit(1)).alias("m"), F.max("home").alias("top"), F.min("home").alias("low"), F.bit_xor(who[0]).alias("x"), F.bit_xor(who[1]).alias("y"))
    groups = groups.filter("m > 1 and low = s").groupBy("s", "m", "x", "y").agg(F.min("h").alias("h"))
    met = written(met.join(groups.select("h", "s", "m"), ["h", "s"]).select("h", "s", "m", "c"), "met")
    bins = written(classes.filter("c is not null").groupBy("c").agg(F.first("bins").alias("bins")).join(met.select("c").distinct(), "c", "left_semi"), "bins")
    spark = docs.sparkSession
    dealt = met.filter(F.col("m") <= GROUP).join(bins, "c").repartition(partitions(spark), "h", "s").sortWithinPartitions("h", "s", "c")
    stars = _stars_of(dealt, percent)
    crowded = met.filter(F.col("m") > GROUP)
    if not crowded.isEmpty():
        rows = written(_folded(crowded.join(bins, "c").select("h", "s", "c", "bins"), percent), "crowded")
        stars = stars.unionByName(_regions(rows, GROUP_MASS, percent, wide_histograms))
    stars = written(stars.distinct(), "stars")
    return written(components(stars).select(F.col("node").alias("c"), F.col("root").alias("family")), "families")


def links(docs: DataFrame, classes: DataFrame, rarity: np.ndarray, limit: int = REGION_SHINGLES, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text) and their classes -> (a, b): links between classes, enough of them to connect all that links connect."""
    families = _families(docs, classes, rarity, size, percent)
    reps = classes.filter("c is not null").groupBy("c").agg(F.min("doc_id").alias("doc_id"))
    sets = written(_sets(docs, written(reps.join(families, "c"), "wanted"), size), "sets")
    return _regions(sets, limit, percent, Sets)


def similar_groups(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", limit: int = REGION_SHINGLES, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (the least doc_id that links reach).

    Documents link where the Jaccard similarity of their sets of `size`-word shingles is at least `percent` / 100.

    Null texts and texts without a word have no shingles and link with nothing. Rows that repeat a doc_id are documents of
    their own. Rows without a doc_id take part under -1.
    """
    few = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-1)).alias("doc_id"), F.col(text).alias("text"))
    classes, rarity = _classes(few, size)
    joined = components(links(few, classes, rarity, limit, size, percent))
    reps = classes.filter("c is not null").groupBy("c").agg(F.min("doc_id").alias("least"))
    roots = written(reps.join(joined, reps["c"] == joined["node"], "left").select("c", F.coalesce("root", "c").alias("root"), "least"), "roots")
    heads = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = roots.join(heads, "root").select("c", "component_id")
    out = classes.join(by_class, "c", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs whose doc_id is the least of its group; of rows that repeat an id and a text, one."""
    columns = docs.columns
    groups = written(similar_groups(docs, text=text, doc_id=doc_id, size=size, percent=percent), "groups")
    # one way at every size; the ids are the built side, so texts are dealt once and not sorted
    least = groups.filter("doc_id = component_id").select(F.col("doc_id").alias("kept_")).distinct().hint("shuffle_hash")
    kept = docs.join(least, F.coalesce(docs[doc_id].cast("long"), F.lit(-1)) == least["kept_"], "left_semi")
    if not groups.groupBy("doc_id").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates([doc_id, text])
    return kept.select(*[F.col(f"`{c}`") for c in columns])


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"))

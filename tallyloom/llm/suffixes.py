"""Suffix-array deduplication: remove bytes covered by strings of SPAN bytes that also start elsewhere.

A suffix array of every byte position is far larger than the corpus. Two equal strings of SPAN bytes contain the same least
GRAM-byte hash at the same place, so it is enough to sort the suffixes that start at such anchors (about one in 80
positions), with the bytes before the anchor kept beside them: an anchor stands for the strings whose first least hash it is, and
its context is what these cover.

1. Anchors are counted by the hash of their gram. Those that occur once can't repeat and go.
2. Equal contexts (told by 128 bits) become one, with the number of times that it occurs: copies meet as a map-side
   aggregate, and each different context takes part in the sort once.
3. All those contexts' suffixes are merge-sorted across tasks: each task sorts its own, front-codes the run (length of the
   common prefix with the one before, and the rest), and deals it out by gram; receivers combine runs in a loser tree that keeps
   the common prefix with the last winner, so known prefixes are never compared again. The common prefix of
   neighbours to the right, and what precedes the anchors to the left, say which strings two contexts share; a
   context that occurs twice shares all of its own.
4. Repeated strings go back to the documents as byte ranges.

A gram with more than MOST_CONTEXTS different contexts would be one large group. Its contexts are cut into narrower ones,
by the distance of their strings from the anchor, and grouped by all the bytes that these strings have in common instead
of the gram: the same steps, with a longer gram. In the last of STEPS a context is one string, so equal ones are one row. Its contexts are
dealt out by their digests with the runs of the others and come out as their own bytes, so no document is moved again for them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, table, trimmed, written

SPAN = 200
GRAM = 32
MOST_CONTEXTS = 20_000
#: How many neighbouring strings a narrower context of a crowded gram holds, by level.
STEPS = (24, 1)
#: Groups of runs for each shuffle partition: more of them spread evenly.
GROUPS = 16
KEYS = ["key", "check"]
#: Bytes of a gram's hash before its suffix.
HEAD = 8
CONTEXT = "h long, g binary, first int, width int, before int"
#: What becomes of runs: ranges of contexts, or a context of a crowded gram whole (its text).
SHARED = "h long, g binary, start int, end int, text binary, width int, before int, times long"
#: A run is sent off when it holds so many bytes.
RUN_BYTES = 16 << 20

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def gram_hashes(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the gram bytes (a power of two) from each position, by doubling."""
    h, n = (raw.astype(np.uint64) + np.uint64(1)) * _M1, 1
    while n < gram:
        h = h[:-n] * np.uint64(pow(0x9E3779B97F4A7C15, n, 2**64)) + h[n:]
        h ^= h >> np.uint64(31)
        h *= _M2
        n *= 2
    return h


def anchors(raw: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first, last) of each anchor: it stands for the strings of span bytes that start at first .. last."""
    if len(raw) < span:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    h = gram_hashes(raw, gram)
    width, step = span - gram + 1, 1
    least = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if rest := width - step:
        least = np.minimum(least[:-rest], least[rest:])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return h[at[first]], at[first], first, np.append(first[1:], len(at)) - 1


def spans_of(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal ranges covered by [start, end) ranges; ranges that touch join."""
    out: list[tuple[int, int]] = []
    for k in np.argsort(starts, kind="stable"):
        s, e = int(starts[k]), int(ends[k])
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _grams(docs: DataFrame) -> DataFrame:
    """(key, check, text) -> (h): grams of anchors that occur more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 512) for b in batches for k in range(0, b.num_rows, 512)):
            found = [anchors(np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8))[0] for t in batch.column(0).to_pylist()]
            h, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    return docs.select("text").mapInArrow(trimmed(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h")


def _binaries(values: bytes, size: int) -> pa.Array:
    n = len(values) // size
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, size * n + 1, size, dtype=np.int32)), pa.py_buffer(values)])


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """(key, check, text) -> (key, check, h, g, first, width, before, more): a document's different contexts.

    first: where the context starts; more: where else it does, null if nowhere. g is the digest of its bytes.
    """
    names = [*KEYS, "h", "g", "first", "width", "before", "more"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 512) for b in batches for k in range(0, b.num_rows, 512)):
            out: list[list[np.ndarray]] = [[] for _ in range(4)]
            digests, more, row = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                data = (text or "").encode("utf-8", "surrogatepass")
                h, at, first, last = anchors(np.frombuffer(data, np.uint8))
                if not len(h):
                    continue
                own = [xxhash.xxh3_128_digest(data[a : b + SPAN]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
                one, again = np.arange(len(h)), [None] * len(h)
                if len(np.unique(h)) < len(h):
                    places: dict[bytes, list[int]] = {}
                    for k, g in enumerate(own):
                        places.setdefault(g, []).append(k)
                    one = np.array([ks[0] for ks in places.values()])
                    own, again = list(places), [first[ks[1:]].tolist() or None for ks in places.values()]
                digests += own
                more += again
                row.append(np.full(len(one), i))
                for o, v in zip(out, (h.view(np.int64), first, last - first + 1, at - first), strict=True):
                    o.append(v[one])
            if row:
                where = pa.array(np.concatenate(row))
                h, first, width, before = (np.concatenate(o) for o in out)
                columns = [batch.column(0).take(where), batch.column(1).take(where), pa.array(h), _binaries(b"".join(digests), 16), *(pa.array(x, pa.int32()) for x in (first, width, before)), pa.array(more, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(trimmed(run), f"key long, check int, {CONTEXT}, more array<int>")


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of a and b, of which `known` bytes are known to be equal."""
    n = min(len(a), len(b))
    while known < n:
        x, y = a[known : known + 64], b[known : known + 64]
        if x == y:
            known += len(x)
            continue
        m = min(len(x), len(y))
        diff = int.from_bytes(x[:m], "big") ^ int.from_bytes(y[:m], "big")
        return known + (m if not diff else m - (diff.bit_length() + 7) // 8)
    return n


def front_coded(suffixes: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Sorted suffixes -> lengths of the common prefix with the one before, and the rests."""
    lengths, rests, before = [], [], b""
    for s in suffixes:
        n = common_prefix(before, s)
        lengths.append(n)
        rests.append(s[n:])
        before = s
    return lengths, rests


def merged(runs: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[int, int, bytes, int]]:
    """Front-coded sorted runs -> (run, place in it, suffix, common prefix with the one before), in order.

    A loser tree: each inner node keeps the loser of its match with the length of its common prefix with the winner. Of two
    contenders whose prefixes with the last winner differ, the longer is less, and nothing is compared; if they are
    equal, comparison starts after them.
    """
    k = len(runs)
    if not k:
        return
    size = 1 << (k - 1).bit_length()
    heads: list[bytes | None] = [None] * size
    known, place = [0] * size, [-1] * size

    def advance(r: int) -> None:
        place[r] += 1
        lengths, rests = runs[r]
        if place[r] < len(lengths):
            heads[r] = (heads[r] or b"")[: lengths[place[r]]] + rests[place[r]]
            known[r] = lengths[place[r]]
        else:
            heads[r], known[r] = None, -1

    def less(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) with the loser's known prefix now that with the winner."""
        x, y = heads[a], heads[b]
        if known[a] != known[b] or x is None or y is None:
            return (a, b) if known[a] > known[b] else (b, a)
        n = common_prefix(x, y, known[a])
        if x[n : n + 1] < y[n : n + 1] or (x[n : n + 1] == y[n : n + 1] and a < b):
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    for r in range(k):
        advance(r)
    for r in range(k, size):
        known[r] = -1
    losers = [0] * (2 * size)

    def play(node: int) -> int:
        if node >= size:
            return node - size
        won, lost = less(play(2 * node), play(2 * node + 1))
        losers[node] = lost
        return won

    winner = play(1) if size > 1 else 0
    while heads[winner] is not None:
        yield winner, place[winner], heads[winner], known[winner]
        advance(winner)
        node = (winner + size) >> 1
        while node:
            winner, losers[node] = less(winner, losers[node])
            node >>= 1


def _bytes(text: str | bytes) -> bytes:
    return text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")


def _with_text(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """(key, check, text), contexts of documents -> (text, list of the contexts)."""
    listed = contexts.groupBy(*KEYS).agg(F.collect_list(F.struct(*[c for c in contexts.columns if c not in KEYS])).alias("list"))
    return docs.join(listed.hint("shuffle_hash"), KEYS).select("text", "list")


def _runs(docs: DataFrame, contexts: DataFrame, parts: int) -> DataFrame:
    """Documents and their contexts -> front-coded sorted runs, dealt out by gram; those of crowded grams by their digests.

    A suffix is written after the hash of its gram, so a run, and what is merged of runs, is in order of grams.
    """
    schema = "part int, lcp array<int>, rest array<binary>, lefts array<binary>, g array<binary>, width array<int>, times array<long>, crowded array<boolean>"
    types = [pa.int32(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.bool_())]
    names = [c.split()[0] for c in schema.split(", ")]

    def flush(held: dict[int, list[tuple]]) -> Iterator[pa.RecordBatch]:
        for part, rows in held.items():
            rows.sort(key=lambda r: r[0])
            lcp, rest = front_coded([r[0] for r in rows])
            _, lefts, g, width, times, crowded = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, lcp, rest, lefts, g, width, times, crowded), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        size = 0
        for batch in batches:
            for text, contexts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = _bytes(text)
                for c in contexts:
                    first, at = c["first"], c["first"] + c["before"]
                    end = first + c["width"] - 1 + SPAN
                    part = (int.from_bytes(c["g"][:8], "big") if c["crowded"] else c["h"]) % parts
                    held.setdefault(part, []).append((c["h"].to_bytes(HEAD, "big", signed=True) + data[at:end], data[first:at], c["g"], c["width"], c["times"], c["crowded"]))
                    size += end - first + 64
                if size > RUN_BYTES:
                    yield from flush(held)
                    held, size = {}, 0
        yield from flush(held)

    return _with_text(docs, contexts).mapInArrow(trimmed(run), schema)


def shared_strings(suffixes: list[bytes], lefts: list[bytes], widths: list[int], lcps: list[int]) -> list[np.ndarray]:
    """Contexts of one gram in suffix order -> for each, which of its strings (by start after the context's own) another shares.

    A string that starts o bytes before the anchor is shared by two contexts if their suffixes agree in SPAN - o bytes and
    the o bytes before their anchors are equal. Both then have it, as its anchor depends on it alone.
    """
    m = len(suffixes)
    out = [np.zeros(w, bool) for w in widths]
    if m <= 8:
        for i in range(m):
            right = SPAN
            for j in range(i + 1, m):
                right = min(right, lcps[j])
                a, b = lefts[i], lefts[j]
                left = common_prefix(a[::-1], b[::-1])
                low, high = SPAN - right, left
                for x in (i, j):
                    # offset o starts at place len(left) - o
                    s, e = max(0, len(lefts[x]) - high), min(widths[x], len(lefts[x]) - low + 1)
                    if s < e:
                        out[x][s:e] = True
        return out
    longest = max(map(len, lefts))
    back = np.zeros((m, longest + 1), np.int64)
    for i, left in enumerate(lefts):
        back[i, 1 : len(left) + 1] = np.frombuffer(left[::-1], np.uint8)
    code = np.zeros(m, np.int64)  # equal for equal bytes before the anchor, as many as are looked at
    sizes, wide, lcp = np.array([len(x) for x in lefts]), np.array(widths), np.array(lcps)
    for o in range(longest + 1):
        if o:
            _, code = np.unique(code << 8 | back[:, o], return_inverse=True)
        has = np.flatnonzero((sizes >= o) & (sizes - o < wide))
        if len(has) < 2:
            continue
        cluster = np.cumsum(lcp < SPAN - o)
        _, where, times = np.unique(code[has] << 32 | cluster[has], return_inverse=True, return_counts=True)
        for x in has[times[where] > 1]:
            out[x][sizes[x] - o] = True
    return out


def _merge_part(group: pa.Table) -> pa.Table:
    """The runs of one part -> SHARED: byte ranges, from a context's start, of strings that occur again; contexts of crowded grams as they are."""
    columns = {n: group.column(n).to_pylist() for n in group.column_names}
    rows: list[tuple] = []
    whole: dict[bytes, tuple] = {}

    def close(held: list[tuple]) -> None:
        suffixes, lcps, where = zip(*held, strict=True)
        h = int.from_bytes(suffixes[0][:HEAD], "big", signed=True)
        widths = [columns["width"][r][i] for r, i in where]
        found = shared_strings([x[HEAD:] for x in suffixes], [columns["lefts"][r][i] for r, i in where], widths, list(lcps)) if len(held) > 1 else [np.zeros(widths[0], bool)]
        for (r, i), which in zip(where, found, strict=True):
            if columns["times"][r][i] > 1:
                which[:] = True
            starts = np.flatnonzero(which)
            rows.extend((h, columns["g"][r][i], s, e) for s, e in spans_of(starts, starts + SPAN))

    held: list[tuple] = []
    seen: set[bytes] = set()
    pending = 0
    for r, i, suffix, lcp in merged(list(zip(columns["lcp"], columns["rest"], strict=True))):
        g = columns["g"][r][i]
        pending = min(pending, lcp)
        if columns["crowded"][r][i]:  # a gram of its own, so what comes next starts anew
            left = columns["lefts"][r][i]
            whole[suffix[:HEAD] + g] = (int.from_bytes(suffix[:HEAD], "big", signed=True), g, left + suffix[HEAD:], columns["width"][r][i], len(left), columns["times"][r][i])
            continue
        if pending < HEAD:
            if held:
                close(held)
            held, seen = [], set()
        elif g in seen:  # the same context from a repeated row
            continue
        held.append((suffix, max(0, pending - HEAD), (r, i)))
        seen.add(g)
        pending = len(suffix)
    if held:
        close(held)
    rows = [(h, g, s, e, None, None, None, None) for h, g, s, e in rows] + [(h, g, None, None, *rest) for h, g, *rest in whole.values()]
    types = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int64()]
    return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * len(types), types, strict=True)], [c.split()[0] for c in SHARED.split(", ")])


def _narrowed(docs: DataFrame, contexts: DataFrame, step: int) -> DataFrame:
    """Contexts -> (h0, g0, by, h, g, key, check, first, width, before, times): each cut into contexts of `step` strings or fewer.

    Strings that start o bytes before the anchor are cut at multiples of step of o. All of a narrower context's strings,
    and those of any other cut alike, share the bytes from its last start to its first end, which take the gram's place.
    by: where it begins after the start of the wider one, (h0, g0).
    """
    schema = f"h0 long, g0 binary, by int, key long, check int, {CONTEXT}, times long"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 64) for b in batches for k in range(0, b.num_rows, 64)):
            rows = []
            for text, contexts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = _bytes(text)
                for c in contexts:
                    at = c["first"] + c["before"]
                    high = c["before"]  # strings start at most so many bytes before the anchor, and at least low
                    low = high - c["width"] + 1
                    for k in range(low // step, high // step + 1):
                        s, e = at - min(high, k * step + step - 1), at - max(low, k * step)
                        core = data[at - k * step : at - k * step - step + 1 + SPAN]
                        h = xxhash.xxh3_64_intdigest(core, k) - 2**63
                        rows.append((c["h"], c["g"], s - c["first"], c["id"]["key"], c["id"]["check"], h, xxhash.xxh3_128_digest(data[s : e + SPAN]), s, e - s + 1, at - s, c["times"]))
            types = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), *[pa.int32()] * 3, pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * len(types), types, strict=True)], names)

    return _with_text(docs, contexts.withColumn("id", F.struct(*KEYS))).mapInArrow(trimmed(run), schema)


def _different(rows: DataFrame, times) -> DataFrame:
    """Contexts of documents -> written: each different one once, with the times it occurs and one place."""
    at = F.min(F.struct(*KEYS, "first", "width", "before")).alias("at")
    return written(rows.groupBy("h", "g").agg(F.sum(times).alias("times"), at).select("h", "g", "times", "at.*"), "contexts")


def _shared(docs: DataFrame, contexts: DataFrame, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """Different contexts -> written (h, g, start, end): ranges, from a context's start, of strings that occur again."""
    spark = docs.sparkSession
    crowded = written(contexts.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MOST_CONTEXTS).select("h"), "crowded") if steps else None
    some = crowded is not None and not crowded.isEmpty()
    # at most a row for MOST_CONTEXTS contexts
    flagged = contexts.join(F.broadcast(crowded.withColumn("met", F.lit(True))), "h", "left").withColumn("crowded", F.coalesce("met", F.lit(False))).drop("met") if some else contexts.withColumn("crowded", F.lit(False))
    out = written(_runs(docs, flagged, GROUPS * partitions(spark)).groupBy("part").applyInArrow(_merge_part, SHARED), "shared")
    few = out.filter("text is null").select("h", "g", "start", "end")
    if not some:
        return few
    own = out.filter("text is not null").select("h", "g", "times", F.xxhash64("h", "g").alias("key"), F.hash("g", "h").alias("check"), F.lit(0).alias("first"), "width", "before", "text")
    docs, contexts = own.select(*KEYS, "text"), own.drop("text")
    narrow = written(_narrowed(docs, contexts, steps[0]), "narrow")
    found = _shared(docs, _different(narrow, F.col("times")), steps[1:])
    back = narrow.select("h0", "g0", "by", "h", "g").join(found, ["h", "g"])
    return few.unionByName(back.select(F.col("h0").alias("h"), F.col("g0").alias("g"), (F.col("start") + F.col("by")).alias("start"), (F.col("end") + F.col("by")).alias("end")))


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(key, check, text) -> written (key, check, ranges): byte ranges [start, end) of each row's text that repeat; rows without any are left out."""
    twice = written(_grams(docs), "grams")
    repeated = written(_anchor_rows(docs).join(twice.hint("shuffle_hash"), "h", "left_semi"), "anchors")
    others = F.coalesce("more", F.array().cast("array<int>"))
    known = _shared(docs, _different(repeated, 1 + F.size(others)))
    found = repeated.join(known, ["h", "g"]).select(*KEYS, "start", "end", F.explode(F.concat(F.array("first"), others)).alias("first"))
    ranges = F.collect_set(F.struct((F.col("first") + F.col("start")).alias("start"), (F.col("first") + F.col("end")).alias("end"))).alias("ranges")
    return written(found.groupBy(*KEYS).agg(ranges), "ranges")


def _cut(docs: DataFrame, output: list[str], keep_text: bool) -> DataFrame:
    """docs with key and ranges -> output columns, n_bytes, n_removed, n_spans, kept_sha256 (and kept text)."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in output] + ["n_bytes long, n_removed long, n_spans long, kept_sha256 string"] + (["kept string"] if keep_text else []))
    names = [*output, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 512) for b in batches for k in range(0, b.num_rows, 512)):
            rows = []
            for text, ranges in zip(batch.column("text_").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                spans = spans_of(np.array([r["start"] for r in ranges]), np.array([r["end"] for r in ranges])) if ranges else []
                kept, at = [], 0
                for s, e in spans:
                    kept.append(data[at:s])
                    at = e
                kept = b"".join([*kept, data[at:]])
                rows.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "ignore")] if keep_text else [])))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.string()] if keep_text else [])]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in output] + [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return docs.mapInArrow(trimmed(run), schema)


def deduplicate(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", keep_text: bool = True) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the text that is left).

    A null text is empty. Repeated rows are occurrences of their own, so they remove each other. In `kept`, bytes of a code
    point that a removal cuts in two are dropped; the digest is of the bytes as they are.
    """
    few = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text_")).withColumn("key", F.xxhash64("doc_id", "text_")).withColumn("check", F.hash("text_", "doc_id"))
    ranges = repeated_ranges(few.select(*KEYS, F.col("text_").alias("text")).filter("text is not null"))
    # one way at every size: ranges, the built side, are far less than texts
    joined = few.join(ranges.hint("shuffle_hash"), KEYS, "left").select("doc_id", "text_", "ranges")
    return _cut(joined, ["doc_id"], keep_text)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"), keep_text=False)

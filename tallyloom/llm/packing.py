"""Best-fit-decreasing packing of tokenised documents into sequences of a fixed length.

Documents become pieces of at most `limit` tokens. Best fit decreasing looks only at lengths, of which there are at most
`limit`, so the search for bins runs on the histogram of lengths: a table of at most `limit` rows, whatever the corpus.
A segment tree over the remaining capacities finds the tightest open bin in logarithmic time; bins of equal remaining
capacity are runs of consecutive sequence numbers, and a run of pieces of one length is placed into such a run in one
step. The plan says, for every length and interval of ranks, which sequence and offset a piece gets. Pieces get their
rank within their length from counts of each task (a shuffle of counts, not of pieces), and look their place up.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, trimmed, written

LIMIT = 2048
END_ID = 0
#: Entries of a table of words at most; a task lets go of its tables at its end.
CACHED = 200_000
ROWS = 1024
_MARKS = tuple("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
#: White space before a space (so is every character that some table of Unicode calls white space).
_SPACES = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
_CUT = re.compile(r"(?<=[^\t-\r\x1c-\x20\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]) ").split
_TOKENIZERS: dict[str, "CachedTokenizer"] = {}


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class CachedTokenizer:
    """Ids of a byte-level BPE tokenizer file as little-endian unsigned 32-bit integers.

    Such a tokenizer splits a text into words by a fixed pattern and encodes each word by itself. A word holds a space only
    at its start or among white space, so a text can be cut before each space that follows no white space: what lies
    between two such cuts is encoded alike wherever it stands. Arrow cuts a batch and finds the different cuts; only
    these meet Python. Their ids are kept in tables that begin anew at CACHED entries, until forget(): a worker lives on
    when its task is over. Texts that hold a special token's string go to the tokenizer whole.
    """

    def __init__(self, path: str):
        import json

        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.special = [x["content"] for x in json.load(f).get("added_tokens", [])]
        self.split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        # how the vocabulary writes each byte
        self.letters = {b: x for c in range(0x800) for b, x in zip(chr(c).encode(), self.split(chr(c))[0][0], strict=True)}
        self.bpe = self.tokenizer.model.tokenize
        self.words: dict[str, bytes] = {}
        self.cuts: dict[str, bytes] = {}

    def forget(self) -> None:
        self.words, self.cuts = {}, {}

    def _word(self, w: str) -> bytes:
        """Ids of a word as the vocabulary writes it."""
        known = self.words.get(w)
        if known is None:
            ids = [t.id for t in self.bpe(w)]
            known = self.words[w] = struct.pack(f"<{len(ids)}I", *ids)
        return known

    def _cut(self, cut: str) -> bytes:
        """Ids of a space and the cut after it, which are kept."""
        known = self.cuts.get(cut)
        if known is None:
            if cut.isalpha() and max(cut) < "\u0250":  # one word in every version of Unicode
                ids = [t.id for t in self.bpe((" " + cut).encode().decode("latin-1").translate(self.letters))]
                known = struct.pack(f"<{len(ids)}I", *ids)
            elif cut[-1:] in _MARKS and cut[:-1].isalpha() and max(cut) < "\u0250":
                known = self._cut(cut[:-1]) + self._word(cut[-1])
            else:
                known = b"".join([self._word(w) for w, _ in self.split(" " + cut)])
            self.cuts[cut] = known
        return known

    def _head(self, cut: str) -> bytes:
        return b"".join([self._word(w) for w, _ in self.split(cut)])

    def _row(self, text: str) -> bytes:
        """A text with white space before a space, or with a special token."""
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *cuts = _CUT(text)
        return self._head(first) + b"".join(map(self._cut, cuts))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (no nulls), and where each text's begin (one more at the end)."""
        self.words, self.cuts = ({} if len(x) > CACHED else x for x in (self.words, self.cuts))
        odd = pc.match_substring_regex(texts, _SPACES)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        rows = pc.split_pattern(pc.if_else(odd, "", texts), " ")
        flat, starts = pc.dictionary_encode(rows.values), np.array(rows.offsets)
        cuts = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.cuts.get, cuts))
        for i in [i for i, x in enumerate(ids) if x is None]:
            ids[i] = self._cut(cuts[i])
        # a text's first cut has no space before it
        heads = list(map(self._head, rows.values.take(pa.array(starts[:-1])).to_pylist()))
        for r in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            heads[r] = self._row(texts[r].as_py())
        which = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        which[starts[:-1]] = len(ids) + np.arange(len(heads))
        ids += heads
        pool, sizes = np.frombuffer(b"".join(ids), "<u4"), np.array(list(map(len, ids)), np.int64) // 4
        begins = np.cumsum(sizes) - sizes
        ends = np.concatenate([[0], np.cumsum(sizes[which])])
        where = np.arange(ends[-1]) + np.repeat(begins[which] - ends[:-1], sizes[which])
        return pool[where], ends[starts]


def tokenizer(path: str) -> CachedTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = CachedTokenizer(path)
    return _TOKENIZERS[path]


def cut_pieces(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: one if it fits, else the remainder first and full pieces after it."""
    if n <= limit:
        return [(0, n)]
    first = n % limit or limit
    return [(0, first)] + [(s, limit) for s in range(first, n, limit)]


class CapacityTree:
    """Segment tree over remaining capacities 0..limit; a leaf counts the runs of open bins with that capacity."""

    def __init__(self, limit: int):
        self.n = 1 << limit.bit_length()
        self.count = [0] * (2 * self.n)

    def add(self, capacity: int, by: int) -> None:
        i = capacity + self.n
        while i:
            self.count[i] += by
            i >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest capacity with an open bin that is at least `need`."""
        i = need + self.n
        if self.count[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.count[i + 1]:
                i += 1
                while i < self.n:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.n
            i >>= 1
        return None


def best_fit_decreasing(histogram: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int]]:
    """{length: count} -> rows (length, first_rank, first_sequence, per_sequence, offset).

    Pieces of a length with rank r >= first_rank, up to the next row's, lie in sequence first_sequence +
    (r - first_rank) // per_sequence at offset + (r - first_rank) % per_sequence * length.
    """
    tree, runs, plan, bins = CapacityTree(limit), {}, [], 0

    def push(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            runs.setdefault(capacity, []).append((first, n))
            tree.add(capacity, 1)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            if (room := tree.tightest(length)) is not None:
                first, n = runs[room].pop()
                tree.add(room, -1)
            else:
                room, first, n = limit, bins, None
            each = room // length
            need = -(-left // each)
            if n is None:
                n = need
                bins += need
            used = min(n, need)
            put = min(left, used * each)
            plan.append((length, rank, first, each, limit - room))
            full = put // each
            push(room - each * length, first, full)
            if rest := put - full * each:
                push(room - rest * length, first + full, 1)
            push(room, first + used, n - used)
            rank, left = rank + put, left - put
    return plan


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, local_rank long"


def tokenised_pieces(docs: DataFrame, path: str, limit: int, keep_ids: bool) -> DataFrame:
    """(doc_id, text) -> one row a piece, with the task's number and the piece's rank among the task's pieces of its length."""
    schema = PIECES + (", ids binary" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, seen = tokenizer(path), TaskContext.get().partitionId(), np.zeros(limit + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                texts = pc.fill_null(some.column(1), "")
                ids, starts = known.encode(texts.cast(pa.string()))
                rows: list[tuple] = []
                for doc_id, a, b in zip(some.column(0).to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    whole = ids[a:b].tobytes() + END_ID.to_bytes(4, "little")
                    for k, (start, length) in enumerate(cut_pieces(len(whole) // 4, limit)):
                        own = whole[4 * start : 4 * (start + length)]
                        rows.append((doc_id, k, start, length, zlib.crc32(own), part, int(seen[length]), *([own] if keep_ids else [])))
                        seen[length] += 1
                types = [pa.int64(), pa.int32(), *[pa.int64()] * 5, *([pa.binary()] if keep_ids else [])]
                names = [x.split()[0] for x in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        known.forget()

    return docs.mapInArrow(trimmed(run), schema)


def pack_documents(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", tokenizer_path: str | None = None, limit: int = LIMIT, keep_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for).

    A null text is empty: its one piece is the end id. Rows that repeat a doc_id are documents of their own with the same
    numbers. Other columns are ignored. No text is cut short; only documents above `limit` tokens become several pieces.
    """
    spark = docs.sparkSession
    few = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = written(tokenised_pieces(few, tokenizer_path or default_tokenizer_path(), limit, keep_ids), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # `limit` rows at most
    plan = np.array(sorted(best_fit_decreasing(histogram, limit)), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(plan)
    ranked = pieces.join(counts.select("length", "part", "base"), ["length", "part"]).withColumn("rank", F.col("base") + F.col("local_rank"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "") + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, ranks, first, each, offset = shared.value.T
        top = int(ranks.max(initial=0)) + 1
        for batch in batches:
            length, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            # rows are sorted by (length, first_rank); the row of a piece is the last that is not above it
            row = np.searchsorted(lengths * top + ranks, length * top + np.minimum(rank, top - 1), side="right") - 1
            past = rank - ranks[row]
            placed = [pa.array(first[row] + past // each[row]), pa.array(offset[row] + past % each[row] * length)]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + placed, names + ["sequence_id", "offset"])

    return ranked.select(*names, "rank").mapInArrow(trimmed(place), schema)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))

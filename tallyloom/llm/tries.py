"""Conversation prefix trie, built as mergeable partial tries.

A node is a distinct sequence of first d turns. Its key is a polynomial of the turns' digests modulo a prime, so the key of a
sequence follows from those of its parts: a conversation of any length is cut into pieces that tasks read on their own, and
only (key, length) of a piece travels to the pieces after it.

1. Turns (digest and length, no texts) are sorted by range of (conversation, turn) and become pieces of at most PIECE turns.
2. Each task builds the partial trie of its pieces: a table of nodes with members counted, smallest member and end list.
3. Partial tries are merged by key in rounds of FAN tasks' tables, so no merge meets more than FAN rows of a node, not even
   of the root. End lists are merged as runs sorted by range; a node's digest then reads blocks of PIECE ids, one after the other.
4. The rollup runs bottom-up over paths. Each node belongs to the path of that member whose hashed id is the least, so the
   nodes of a path are a stretch of one conversation, and a walk from a leaf to the root changes path about ln(members) times
   whatever the depth. Path totals climb from path to path, one join a change; sums along a path close each node's subtree.

SHA-256 over an end list can't be computed in parts: the digest of one node is one task's work, which streams blocks and
holds one. Keys are as good as 127 random bits for texts that weren't made to collide.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, table, trimmed, written

#: Turns of a conversation in a piece, ids in a block of an end list, depths in a block of a path.
PIECE = 4096
#: Tables of nodes that meet in a merge; nodes or ends after which a task hands on its partial trie and begins another.
FAN, HELD = 64, 100_000
#: Turns that a rebuilt conversation takes from its base at most, and conversations that share a base.
HEAD, SHARED = 5, 100
PRIME, BASE = 2**127 - 1, 0x2545F4914F6CDD1D9E3779B97F4A7C15
NO_ENDS = hashlib.sha256(b"").hexdigest()

_PIECES = "conv_id long, part int, piece long, n long, turns string, chars array<long>, whole boolean"
_NODES = "key binary, parent binary, depth long, chars long, n_convs long, conv_id long, rank long, path long, ends array<long>, tables long"


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, chars) of each turn: null role or text is empty, rows without conv_id take no part."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    return conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))


def _cut(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Sorted turns of a partition -> pieces. A piece is whole if its conversation surely lies in this partition and this piece alone."""
    part, held, first, out = TaskContext.get().partitionId(), None, None, []

    def end(last: bool) -> None:
        if held:
            out.append((held[0], part, held[1], len(held[3]), "".join(held[2]), held[3], not last and held[1] == 0 and held[0] != first and len(held[3]) < size))

    for batch in batches:
        for conv, digest, chars in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "digest", "chars")), strict=True):
            first = conv if first is None else first
            if held and (held[0] != conv or len(held[3]) == size):
                end(False)
                held = [conv, held[1] + 1 if held[0] == conv else 0, [], []]
            held = held or [conv, 0, [], []]
            held[2].append(digest)
            held[3].append(chars)
        yield _rows(out, _PIECES)
        out.clear()
    end(True)
    yield _rows(out, _PIECES)


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    fields = [f.rsplit(" ", 1) for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def pieces_of(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """Turns -> pieces in order of turn (null first), equal turns by digest, with `before`, the conversation's turns in earlier pieces, and `total`, all its turns."""
    turns = written(turns, "turns").withColumn("row", F.monotonically_increasing_id())  # repeated rows don't all meet in one range
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest", "row"]
    cut = written(turns.repartitionByRange(partitions(turns.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(trimmed(partial(_cut, size=piece)), _PIECES), "pieces")
    whole = cut.filter("whole").withColumns({"before": F.lit(0).cast("long"), "total": F.col("n")})
    conv = Window.partitionBy("conv_id")
    places = cut.filter("not whole").select("conv_id", "part", "piece", F.coalesce(F.sum("n").over(conv.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(conv).alias("total"))
    return whole.unionByName(cut.filter("not whole").join(places, ["conv_id", "part", "piece"])).drop("whole")


def rebuilt(pieces: DataFrame) -> DataFrame:
    """Pieces with what their conversation c is rebuilt from: `h`, the own turns that it leaves out, and `head`, `head_chars`, the first h turns of conversation c - c % SHARED.

    A conversation without a base (it isn't there) takes none. % has the sign of its left side, as in SQL.
    """
    first = F.struct("before", F.substring("turns", 1, 32 * HEAD).alias("turns"), F.slice("chars", 1, HEAD).alias("chars"))
    heads = pieces.filter((F.col("before") < HEAD) & (F.col("conv_id") % SHARED == 0)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(first)).alias("firsts"))
    heads = heads.select("base", F.array_join(F.transform("firsts", lambda x: x["turns"]), "").alias("head"), F.flatten(F.transform("firsts", lambda x: x["chars"])).alias("head_chars"))
    pieces = pieces.withColumn("base", F.col("conv_id") - F.col("conv_id") % SHARED).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1))
    out = pieces.join(heads, "base", "left").drop("base")
    taken = F.coalesce(F.slice("head_chars", F.lit(1), F.col("h").cast("int")), F.array().cast("array<long>"))
    return out.withColumns({"head": F.coalesce(F.substring("head", F.lit(1), (F.col("h") * 32).cast("int")), F.lit("")), "head_chars": taken, "rank": F.xxhash64("conv_id")})


def _key(state: int, turns: str) -> int:
    for i in range(0, len(turns), 32):
        state = (state * BASE + int(turns[i : i + 32], 16) + 1) % PRIME
    return state


def _own(turns: str, before: int, h: int) -> str:
    """A piece's turns after the conversation's first h."""
    return turns[32 * max(0, h - before) :]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            own = _own(r["turns"], r["before"], r["h"])
            out.append((r["conv_id"], r["part"], r["piece"], len(own) // 32, f"{_key(0, own):032x}", f"{_key(0, r['head']):032x}", len(r["head"]) // 32))
        yield _rows(out, _SUMS)


_SUMS = "conv_id long, part int, piece long, own long, sum string, start string, depth long"
_STATES = "conv_id long, part int, piece long, state string, depth long"


def _chain(rows: pa.Table) -> pa.Table:
    """Of one conversation's pieces: the key and depth that each begins at."""
    out, state, depth = [], None, 0
    for r in sorted(rows.to_pylist(), key=lambda r: (r["part"], r["piece"])):
        if state is None:
            state, depth = int(r["start"], 16), r["depth"]
        out.append((r["conv_id"], r["part"], r["piece"], f"{state:032x}", depth))
        state, depth = (state * pow(BASE, r["own"], PRIME) + int(r["sum"], 16)) % PRIME, depth + r["own"]
    return pa.Table.from_batches([_rows(out, _STATES)])


def with_states(units: DataFrame) -> DataFrame:
    """+ state, depth: the node that a piece begins at; null for a conversation's first piece, which begins at the root."""
    several = units.filter("n < total").select("conv_id", "part", "piece", "turns", "before", "h", "head")
    states = several.mapInArrow(_sums, _SUMS).groupBy("conv_id").applyInArrow(_chain, _STATES)
    return units.join(states, ["conv_id", "part", "piece"], "left")


class _Partial:
    """The trie of what a task has read: key -> [parent, depth, chars, members, smallest member, its rank's least, that member, ends]."""

    def __init__(self) -> None:
        self.nodes: dict[int, list] = {}
        self.ends = 0

    def visit(self, key: int, parent: int | None, depth: int, chars: int, conv: int, rank: int) -> None:
        if (node := self.nodes.get(key)) is None:
            self.nodes[key] = [parent, depth, chars, 1, conv, rank, conv, []]
            return
        node[3] += 1
        node[4] = min(node[4], conv)
        node[5], node[6] = min((node[5], node[6]), (rank, conv))

    def end(self, key: int, conv: int) -> None:
        self.nodes[key][7].append(conv)
        self.ends += 1

    def rows(self, tables: int) -> pa.RecordBatch:
        out = [(k.to_bytes(16), None if p is None else p.to_bytes(16), d, x, n, c, r, m, e, tables) for k, (p, d, x, n, c, r, m, e) in self.nodes.items()]
        self.__init__()
        return _rows(out, _NODES)


def _tries(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[pa.RecordBatch]:
    task, trie = TaskContext.get().partitionId(), _Partial()
    for batch in batches:
        for r in batch.to_pylist():
            conv, rank, skip = r["conv_id"], r["rank"], max(0, r["h"] - r["before"])
            turns, chars = _own(r["turns"], r["before"], r["h"]), r["chars"][skip:]
            state, depth = (int(r["state"], 16), r["depth"]) if r["state"] else (0, 0)
            if r["before"] == 0:
                state, depth, turns, chars = 0, 0, r["head"] + turns, r["head_chars"] + chars
                trie.visit(0, None, 0, 0, conv, rank)
            for i, n in enumerate(chars):
                parent, state, depth = state, _key(state, turns[32 * i : 32 * i + 32]), depth + 1
                trie.visit(state, parent, depth, n, conv, rank)
            if r["before"] + r["n"] == r["total"]:
                if state not in trie.nodes:  # the piece adds no turn of its own: an end without a member
                    trie.nodes[state] = [None, depth, 0, 0, conv, rank, conv, []]
                trie.end(state, conv)
            if len(trie.nodes) + trie.ends > held:
                yield trie.rows(task)
    yield trie.rows(task)


def partial_tries(units: DataFrame, held: int = HELD) -> DataFrame:
    """Each task's tables of nodes. An end without a member has n_convs 0: its node is in another piece's table."""
    return units.mapInArrow(trimmed(partial(_tries, held=held)), _NODES)


def merged(partials: DataFrame, fan: int = FAN) -> DataFrame:
    """Partial tries -> one row a node, by rounds of merges of `fan` tables each."""
    tables = (partials.agg(F.max("tables")).first()[0] or 0) + 1
    nodes = partials.filter("n_convs > 0").drop("ends")
    while True:
        tables = math.ceil(tables / fan)
        nodes = nodes.withColumn("tables", F.floor(F.col("tables") / fan)).groupBy("key", "tables").agg(
            F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("chars").alias("chars"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min(F.struct("rank", "path")).alias("least")
        )
        nodes = nodes.select("key", "tables", "parent", "depth", "chars", "n_convs", "conv_id", "least.rank", "least.path")
        if tables == 1:
            return nodes.drop("tables", "rank")


_BLOCKS = "key binary, part int, piece long, whole boolean, ids string"
_DIGESTS = "key binary, ends_sha256 string"


def _joined(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Sorted (key, id) -> blocks of ids as text. A block is whole if it surely has all ids of its key."""
    part, held, first, out = TaskContext.get().partitionId(), None, None, []

    def end(last: bool) -> None:
        if held:
            out.append((held[0], part, held[1], not last and held[1] == 0 and held[0] != first and len(held[2]) < size, ",".join(map(str, held[2]))))

    for batch in batches:
        for key, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            first = key if first is None else first
            if held and (held[0] != key or len(held[2]) == size):
                end(False)
                held = [key, held[1] + 1 if held[0] == key else 0, []]
            held = held or [key, 0, []]
            held[2].append(conv)
        yield _rows(out, _BLOCKS)
        out.clear()
    end(True)
    yield _rows(out, _BLOCKS)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by key and place -> the digest of each key's ids, a block at a time."""
    now, digest = None, None
    for batch in batches:
        out = []
        for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if key != now:
                if now is not None:
                    out.append((now, digest.hexdigest()))
                now, digest = key, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield _rows(out, _DIGESTS)
    if now is not None:
        yield _rows([(now, digest.hexdigest())], _DIGESTS)


def end_digests(partials: DataFrame, piece: int = PIECE) -> DataFrame:
    """(key, ends_sha256) of the nodes at which conversations end."""
    ends = written(partials.filter(F.size("ends") > 0).select("key", F.explode("ends").alias("conv_id")), "ends")
    blocks = written(ends.repartitionByRange(partitions(ends.sparkSession), "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(trimmed(partial(_joined, size=piece)), _BLOCKS), "end-blocks")
    whole = blocks.filter("whole").select("key", F.sha2("ids", 256).alias("ends_sha256"))
    others = blocks.filter("not whole").drop("whole").repartition("key").sortWithinPartitions("key", "part", "piece").mapInArrow(trimmed(_digests), _DIGESTS)
    return whole.unionByName(others)


def rolled_up(nodes: DataFrame, piece: int = PIECE) -> DataFrame:
    """Nodes -> + parent_conv_id, n_children, n_leaves, saved_tokens, the last two over the subtree."""
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("path").alias("up_path"), F.col("depth").alias("up_depth"))
    counts = nodes.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(above, "parent", "left").join(counts, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = written(nodes.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("chars")}), "trie")
    links = nodes.filter("up_path <> path").select("path", "up_path", "up_depth")
    climbing = nodes.groupBy("path").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    hung = []
    while True:
        hung.append(written(climbing.join(links, "path").groupBy("up_path", "up_depth").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")), "climbed"))
        if hung[-1].isEmpty():
            break
        climbing = hung[-1].groupBy(F.col("up_path").alias("path")).agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    side = hung[0]
    for x in hung[1:-1]:
        side = side.unionByName(x)
    side = side.groupBy(F.col("up_path").alias("path"), F.col("up_depth").alias("depth")).agg(F.sum("leaf").alias("side_leaf"), F.sum("saved").alias("side_saved"))
    nodes = nodes.join(side, ["path", "depth"], "left").withColumn("block", F.floor(F.col("depth") / piece))
    nodes = nodes.withColumns({c: F.col(c) + F.coalesce(f"side_{c}", F.lit(0)) for c in ("leaf", "saved")})
    blocks = nodes.groupBy("path", "block").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    below = Window.partitionBy("path").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    later = blocks.select("path", "block", F.sum("leaf").over(below).alias("later_leaf"), F.sum("saved").over(below).alias("later_saved")).filter("later_leaf is not null")
    down = Window.partitionBy("path", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    out = nodes.withColumns({"n_leaves": F.sum("leaf").over(down), "saved_tokens": F.sum("saved").over(down)}).join(later, ["path", "block"], "left")
    return out.withColumns({"n_leaves": F.col("n_leaves") + F.coalesce("later_leaf", F.lit(0)), "saved_tokens": F.col("saved_tokens") + F.coalesce("later_saved", F.lit(0))})


def prefix_trie(conversations: DataFrame, *, piece: int = PIECE, fan: int = FAN, held: int = HELD) -> DataFrame:
    """The trie of all rebuilt conversations: one row a node with key, conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Rows without conv_id take no part; null turns come first; equal turns are ordered by the digest of role and text, repeated
    rows are turns of their own. Columns besides conv_id, turn, role, text are ignored. A conversation whose rebuilt form has
    no turn is a member of the root and ends there. An empty table has no node, not even a root.
    """
    units = written(with_states(rebuilt(pieces_of(turns_of(conversations), piece))), "units")
    partials = written(partial_tries(units, held), "tries")
    nodes = rolled_up(written(merged(partials, fan), "nodes"), piece)
    return nodes.join(end_digests(partials, piece), "key", "left").select("key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations")).drop("key")


OP13_SQL = """
WITH ids AS (
  SELECT conv_id, list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
    lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384)) AS crc
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
), hs AS (
  SELECT conv_id, xor(crc, 4294967295) % 6 AS h FROM ids
), own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), turns AS (
  SELECT c.conv_id, 0 AS part, b.pos, b.role, b.text FROM hs c JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100 AND b.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, o.pos, o.role, o.text FROM hs c JOIN own o ON o.conv_id = c.conv_id AND o.pos > c.h
), placed AS (
  SELECT conv_id, length(text) AS chars, row_number() OVER w AS depth,
    md5(string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS node
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)
), paths AS (
  SELECT conv_id, depth, node, chars FROM placed UNION ALL SELECT conv_id, 0, '', 0 FROM hs
), ended AS (
  SELECT node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT conv_id, arg_max(node, depth) AS node FROM paths GROUP BY conv_id) GROUP BY node
), nodes AS (
  SELECT node, depth, min(chars) AS chars, count(*) AS n_convs, min(conv_id) AS conv_id FROM paths GROUP BY node, depth
), above AS (
  SELECT n.node, p.node AS parent FROM nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1
), children AS (
  SELECT parent, count(*) AS n_children FROM above GROUP BY parent
), under AS (
  SELECT p.node AS top, count(*) FILTER (WHERE k.n_children IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved_tokens
  FROM nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth LEFT JOIN children k ON k.parent = n.node GROUP BY p.node
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children,
  u.n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM nodes n JOIN under u ON u.top = n.node LEFT JOIN above a ON a.node = n.node LEFT JOIN nodes q ON q.node = a.parent
LEFT JOIN children k ON k.parent = n.node LEFT JOIN ended e ON e.node = n.node
"""

"""The prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from tallyloom.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            convs[c].append(((turn is not None, turn or 0, digest), (role, text)))
    convs = {c: [t for _, t in sorted(x)] for c, x in convs.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        path = convs.get(base, [])[:h] + own[h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].add(c)
        ends[tuple(path)].append(c)
    out = []
    for node, m in members.items():
        under = [n for n in members if n[: len(node)] == node]
        children = [n for n in under if len(n) == len(node) + 1]
        leaves = sum(not any(len(k) == len(n) + 1 and k[: len(n)] == n for k in members) for n in under)
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in under if n)
        digest = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children), leaves, saved, digest))
    return sorted(out, key=repr)


def found(df, **sizes):
    rows = tries.prefix_trie(df, **sizes).drop("key").collect()
    return sorted(map(tuple, rows), key=repr)


def some(seed, n=60, most=7):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        c = r.choice([r.randrange(-120, 320), 100 * r.randrange(0, 4)])
        if any(x[0] == c for x in rows):
            continue
        for t in range(r.randrange(1, most)):
            rows.append((c, r.choice([t, t, t, None]), r.choice(["user", "bot", None]), r.choice(["a", "bé", "ccc", "", None, "dd 😀"])))
    rows += rows[:5] + [(None, 0, "user", "lost"), (7777, 0, None, None)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_is_that_of_a_dictionary(spark, seed):
    rows = some(seed)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"path": F.lit("x"), "key": F.lit(1), "n": F.lit(2)})
    assert found(df) == plain(rows)


def test_conversations_in_many_pieces(spark):
    rows = [(200 + i, t, "user", f"turn {t if t < 9 - i else (t, i // 2)}") for i in range(4) for t in range(17)] + [(c, 0, "user", "same") for c in range(300, 340)]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(7), piece=3, fan=2, held=10) == plain(rows)


def test_no_conversations(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)) == []

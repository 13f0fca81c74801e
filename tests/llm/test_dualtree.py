"""Hard negatives against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tallyloom.llm import dualtree

SCHEMA = "vec_id long, label long, vector array<double>, anchor boolean, rid string, dim string, leaf string"


def plain(rows):
    ok = [r for r in rows if None not in r[:3] and all(x is not None and np.isfinite(x) for x in r[2])]
    whole = [[int(np.floor(256 * x)) for x in r[2]] for r in ok]
    out = []
    for a, r in enumerate(ok):
        if not r[3]:
            continue
        found = [(-sum(x * y for x, y in zip(whole[a], whole[b], strict=True)), t[0], b) for b, t in enumerate(ok) if b != a and len(t[2]) == len(r[2])]
        for s, p, _ in sorted(x for x in found if ok[x[2]][1] == r[1])[:5]:
            fits = sorted(x for x in found if ok[x[2]][1] != r[1] and 50 * -s <= 100 * -x[0] <= 95 * -s)
            out += [(r[0], p, k + 1, n, -s, -m) for k, (m, n, _) in enumerate(fits[:3])]
    return sorted(out)


def found(spark, rows, **sizes):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in dualtree.mined(df, **sizes).collect())


def some(seed, n, dim, spread):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dim))
    rows = []
    for i in range(n):
        v = centres[r.integers(6)] + spread * r.normal(size=dim)
        rows.append((i, int(r.integers(3)), (v / np.linalg.norm(v)).tolist(), i % 5 == 0))
    return rows


@pytest.mark.parametrize(("seed", "spread"), [(1, 0.05), (2, 1.0)])
def test_small_trees_find_what_all_pairs_find(spark, seed, spread):
    rows = some(seed, 400, 6, spread)
    assert found(spark, rows, chunk=40, anchors=9, leaf=5, anchor_leaf=2) == plain(rows) != []


def test_odd_rows(spark):
    rows = some(3, 60, 4, 0.5)
    rows += [rows[5]] * 30 + [(0, 1, rows[0][2], True), (None, 1, [1.0] * 4, True), (70, None, [1.0] * 4, True), (71, 1, None, True), (72, 1, [1.0, None, 0.0, 0.0], True), (73, 1, [float("nan")] * 4, False)]
    rows += [(74, 1, [float("inf")] * 4, False), (75, 1, [], True), (76, 1, [], False), (77, 2, [], False), (80, 1, [0.0] * 4, True), (81, 2, [0.3, 0.1], True), (82, 2, [0.3, 0.2], True), (83, 1, [0.2, 0.1], None)]
    random.Random(1).shuffle(rows)
    assert found(spark, rows, chunk=16, anchors=4, leaf=3, anchor_leaf=2) == plain(rows)
    assert found(spark, rows) == plain(rows)


def test_large_components_stay_exact(spark):
    rows = [(i, i % 2, [float(3 * 10**6 + i), 1e6 * (i % 5) + 0.5, -7.0 * i], i % 4 == 0) for i in range(40)]
    assert found(spark, rows, chunk=8, anchors=4, leaf=2, anchor_leaf=2) == plain(rows) != []


def test_nothing(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, 1, [0.5], False), (2, 2, [0.5], False)]) == []


def test_intervals_hold_the_products_and_prune_groups():
    r = np.random.default_rng(4)
    q = np.floor(256 * np.concatenate([r.normal(size=(60, 8)) * 0.05 + c for c in (2 * np.eye(8)[0], -2 * np.eye(8)[1])]))
    x, y = dualtree.Nodes(q[dualtree.halves(q, 8)], 8), dualtree.Nodes(q[dualtree.halves(q, 16)], 16)
    for i in range(len(x.lo)):
        for j in range(len(y.lo)):
            low, high = dualtree.interval(x, np.array([i]), y, np.array([j]))
            s = dualtree.scores(x.q[x.lo[i] : x.hi[i]], y.q[y.lo[j] : y.hi[j]])
            assert low[0] <= s.min() and s.max() <= high[0]
    every = dualtree.leaf_pairs(x, y, lambda i, lo, hi: hi > -np.inf)
    left = dualtree.leaf_pairs(x, y, lambda i, lo, hi: hi >= 200_000)
    assert 0 < len(left) <= len(every) / 2


def test_query_reads_nulls(spark, tmp_path):
    rows = [(i, [0.1 * (i % 9), 0.5, -0.25], i % 10) for i in range(200)] + [(201, None, 3), (None, [0.1, 0.1, 0.1], 3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("score", F.lit(1)).write.parquet(str(tmp_path / "embeddings.parquet"))
    shifted = [(i, (lab + 1) % 10 if i is not None and i % 7 == 0 else lab, None if v is None else np.array(v, np.float32).astype(float).tolist(), i is not None and i % 50 == 0) for i, v, lab in rows]
    assert sorted(tuple(r) for r in dualtree.op11(spark, str(tmp_path)).collect()) == plain(shifted)

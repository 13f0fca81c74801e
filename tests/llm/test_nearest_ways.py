"""Nearest neighbours: recall with the two-hash path open, queries whose buckets hold too few, repeated rows."""

from collections import defaultdict

import numpy as np
from tallyloom.llm import nearest

SCHEMA = "vec_id long, embedding array<double>"


def recall(spark, x, **options):
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    got = defaultdict(set)
    for o in nearest.nearest(spark.createDataFrame(rows, SCHEMA), **options).collect():
        got[o.query_id].add(o.vec_id)
    hit = total = 0
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -np.inf
        hit, total = hit + len(got[q] & set(np.argsort(-s)[:20].tolist())), total + 20
        assert len(got[q]) == 20
    return hit / total


def test_recall_of_vectors_far_apart(spark):
    assert recall(spark, np.random.default_rng(4).normal(size=(2000, 100))) >= 0.9


def test_recall_by_two_hashes(spark, monkeypatch):
    monkeypatch.setattr(nearest, "PROBE_COST", 0)
    used = []
    fit = nearest._fit
    monkeypatch.setattr(nearest, "_fit", lambda *a: used.append(fit(*a)) or used[-1])
    r = np.random.default_rng(5)
    heads = r.normal(size=(60, 60))
    assert recall(spark, np.repeat(heads, 40, axis=0) + 0.15 * r.normal(size=(2400, 60))) >= 0.9
    assert used[0] is not None and used[0][0] == 2


def test_short_queries_are_topped_up(spark, monkeypatch):
    monkeypatch.setattr(nearest, "_fit", lambda *a: (2, 8))
    assert recall(spark, np.random.default_rng(6).normal(size=(400, 100))) >= 0.9


def test_probe_order_of_two_hashes_is_that_of_all_sums():
    q = np.random.default_rng(7).normal(size=20)
    scores = []
    for k in range(2):
        r = nearest.rotated(q[None], 3 * 8 + k)[0]
        scores.append(np.stack([r, -r], axis=1).ravel())
    sums = (scores[0][:, None] + scores[1][None]).ravel()
    assert nearest.probe_order(q, 3, 2, 300).tolist() == np.argsort(-sums, kind="stable")[:300].tolist()


def test_repeated_rows_do_not_fill_a_class(spark):
    rows = [(0, [1.0, 2.0])] * 30 + [(i, [1.0, 2.0]) for i in range(1, 25)]
    out = nearest.nearest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(o.vec_id for o in out if o.query_id == 0) == list(range(1, 21))

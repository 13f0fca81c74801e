"""The pipeline's near-duplicates stage against brute force: five-word shingles, similarity 0.8."""

import random

import corpus_pipeline
import numpy as np
import pytest
from tallyloom.llm import jaccard
from test_operators import COLUMNS, corpus


def near_copies():
    """Groups whose five-word similarity lies around and between 0.80 and 0.85: appended passages, runs of replaced words."""
    r = random.Random(12)
    rows = []
    for g in range(30):
        base = [f"v{r.randrange(3000)}" for _ in range(r.choice([20, 60, 100, 240]))]
        rows.append((7000 + 10 * g, " ".join(base)))
        share = r.uniform(0.16, 0.27)
        rows.append((7001 + 10 * g, " ".join(base + [f"u{r.randrange(3000)}" for _ in range(round(share * len(base)))])))
        at, n = r.randrange(len(base) // 2), max(1, round(r.uniform(0.06, 0.12) * len(base)))
        rows.append((7002 + 10 * g, " ".join(base[:at] + [f"t{r.randrange(3000)}" for _ in range(n)] + base[at + n :])))
    return rows


def least_by_brute_force(rows, size, percent):
    sets = []
    for _, t in rows:
        ws = (t or "").lower().split()
        sets.append({tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))} if ws else set())
    root = list(range(len(rows)))
    between = 0
    for a in range(len(rows)):
        for b in range(a):
            both, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if both and 100 * both >= percent * union:
                between += 100 * both < 85 * union
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root[k]] = min(least.get(root[k], 10**9), i)
    return {i: least[root[k]] for k, (i, _) in enumerate(rows)}, between


def test_stage_links_at_five_words_and_eighty_percent(spark):
    rows = [x for x in {i: (i, t) for i, t in corpus(4, 40) if i is not None}.values()] + near_copies()
    least, between = least_by_brute_force(rows, 5, 80)
    assert between >= 10
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS)
    got = sorted(x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == sorted(i for i in least if least[i] == i)


@pytest.mark.parametrize("limit", [jaccard.REGION_SHINGLES, 2000])
def test_groups_at_any_size_and_percent(spark, limit, monkeypatch):
    monkeypatch.setattr(jaccard, "PIVOTS", 4)
    rows = near_copies()
    least, _ = least_by_brute_force(rows, 5, 80)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in jaccard.similar_groups(docs, limit=limit, size=5, percent=80).collect()}
    assert got == least


def test_bins_clear_no_pair_that_links():
    r = np.random.default_rng(2)
    base = r.integers(0, 2**63, 300, dtype=np.uint64)
    sets = [np.sort(base), np.sort(np.append(base, r.integers(0, 2**63, 75, dtype=np.uint64)))]
    region = jaccard.Histograms([jaccard.histogram(x) for x in sets], 80)
    region.join(np.arange(2))
    assert region.roots(np.arange(2)).tolist() == [0, 0]
    region = jaccard.Histograms([jaccard.histogram(x) for x in sets * 3], 80)
    region.join(np.arange(6))
    assert region.roots(np.arange(6)).tolist() == [0] * 6


@pytest.mark.parametrize("group, mass", [(jaccard.GROUP, jaccard.GROUP_MASS), (4, 100)])
def test_crowded_shingles_are_split_by_pivots(spark, group, mass, monkeypatch):
    for name, value in (("GROUP", group), ("GROUP_MASS", mass), ("PIVOTS", 4)):
        monkeypatch.setattr(jaccard, name, value)
    r = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(3):  # templates with one or a few words of their own
        base = r.choices(words, k=60)
        for j in range(25):
            ws = list(base)
            for _ in range(1 + j % 7):
                ws[r.randrange(60)] = f"own{r.randrange(1000)}"
            rows.append((100 * k + j, " ".join(ws)))
    least, _ = least_by_brute_force(rows, 4, 85)
    out = jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x.doc_id: x.component_id for x in out.collect()} == least


def test_regions_and_windows_at_work_on_the_test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    classes, rarity = jaccard._classes(docs, jaccard.SHINGLE)
    families = jaccard._families(docs, classes, rarity, jaccard.SHINGLE, jaccard.PERCENT)
    reps = classes.filter("c is not null").groupBy("c").agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "doc_id").join(families, "c")
    groups = jaccard._sets(docs, reps, jaccard.SHINGLE).toPandas().groupby("family")
    regions = 0
    for _, group in groups:
        region, plain = (jaccard.Sets(list(group["own"])) for _ in range(2))
        ids = np.arange(len(group))
        region.join(ids)
        plain.pairs(ids)
        assert (region.roots(ids) == plain.roots(ids)).all()
        regions += region.regions
    assert len(groups) and (regions or max(len(g) for _, g in groups) <= jaccard.SMALL_REGION)

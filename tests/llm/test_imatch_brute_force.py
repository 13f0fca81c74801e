"""Fingerprints and likeness against a plain Python version with exact document frequencies."""

import math
import random
import re
from collections import Counter

import xxhash
from tallyloom.llm import imatch


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def chained(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), seed)
    return signed(seed)


def prints(texts):
    sets = [{signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.split(r"[\W_]+", t.lower()) if w} for t in texts]
    df = Counter(t for s in sets for t in s)
    band = {t for t, n in df.items() if imatch.IDF_BAND[0] <= math.log(len(texts) / n) <= imatch.IDF_BAND[1]}
    out = []
    for s in sets:
        kept, parts = sorted(s & band), []
        for j in range(imatch.FAMILIES):
            chain = kept
            for rate in imatch.RATES:
                chain = [t for t in chain if xxhash.xxh64_intdigest(j.to_bytes(4, "little"), xxhash.xxh64_intdigest(t.to_bytes(8, "little", signed=True), 42)) & (rate - 1) == 0]
                parts.append((imatch.RATES.index(rate) * imatch.FAMILIES + j, chained(chain) & 0xFFFFFFFF if chain else None))
        out.append((chained(kept) if kept else None, [v for _, v in sorted(parts)], chained([*sorted(s), -1]) if s else None))
    return out


def likeness(a, b):
    if a[0] == b[0] and (a[0] is not None or a[2] == b[2]):
        return 1.0
    best = 0.0
    for r in range(len(imatch.RATES)):
        x, y = (p[1][r * imatch.FAMILIES : (r + 1) * imatch.FAMILIES] for p in (a, b))
        met = sum(u is not None or v is not None for u, v in zip(x, y, strict=True))
        if met >= imatch.LEAST_MET:
            best = max(best, sum(u is not None and u == v for u, v in zip(x, y, strict=True)) / met)
    return best


def test_fingerprints_and_likeness(spark, tmp_path):
    r = random.Random(8)
    words = [f"term{k}" for k in range(300)]
    texts = [" ".join(r.choices(words, k=r.choice([0, 4, 30, 80]))) for _ in range(40)]
    texts[7] = texts[3]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = sorted(imatch.op2(spark, str(tmp_path)).collect(), key=lambda x: x.doc_id)
    n = len(texts)
    nexts = [texts[(k + 1) % n] for k in range(n)]
    own = prints(texts)
    for k, (row, p) in enumerate(zip(out, own, strict=True)):
        if p[0] is not None:
            parts = "".join("-" if v is None else f"{v:08x}" for v in p[1])
            assert row.fingerprint == f"{p[0] & (2**64 - 1):016x}:{parts}"
        else:
            assert row.fingerprint.startswith("=")
        if p[0] is not None or own[(k + 1) % n][0] is not None:
            assert abs(row.near_next - likeness(p, own[(k + 1) % n])) < 1e-12
        assert row.n_chars == len(texts[k])
        assert (row.fingerprint == row.edited_fingerprint) or texts[k][: len(texts[k]) - len(texts[k]) // 4] + nexts[k][: len(texts[k]) // 4] != texts[k]


def test_rows_of_one_id(spark, tmp_path):
    rows = [(None, "a b c d")] * 40 + [(5, f"one two three {k % 3}") for k in range(30)] + [(9, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = imatch.op2(spark, str(tmp_path)).collect()
    assert Counter(x.doc_id for x in out) == {None: 40, 5: 30, 9: 1}

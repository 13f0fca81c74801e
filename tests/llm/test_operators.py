"""Each operator against brute force on small documents, with nulls, empty and repeated rows, and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tallyloom.llm import graph, htmltext, imatch, jaccard, licences, mixing, nearest, packing, pii, quality, suffixes

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=1, n=60):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghijklmnoé", k=r.randint(2, 9))) for _ in range(900)]
    passage = " ".join(r.choices(words, k=60))
    docs = []
    for i in range(n):
        ws = r.choices(words, k=r.choice([1, 3, 8, 40, 120, 300]))
        t = " ".join(ws)
        if i % 7 == 3:
            t = t[: len(t) // 2] + " " + passage + " " + t[len(t) // 2 :]
        if i % 9 == 5 and docs:
            base = docs[r.randrange(len(docs))][1] or ""
            bs = base.split()
            if bs:
                bs[r.randrange(len(bs))] = "changed"
            t = " ".join(bs)
        docs.append((3 * i, t))
    docs += [(1001, None), (1002, ""), (1003, docs[10][1]), (1003, docs[10][1]), (1004, " \t\n "), (1005, "Word " * 700), (1006, "x" * 5000), (None, "no id here")]
    return docs


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if k % 11 == 0 else f"s{k % 4 if k % 3 else 0}", len(t or "")) for k, (i, t) in enumerate(corpus())]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_mixing_targets_and_bounds(docs):
    out = mixing.mix_sources(docs.withColumn("mix_size", docs.n_chars)).collect()
    assert len(out) == docs.count()
    size, target, taken = defaultdict(int), {}, defaultdict(int)
    for r in out:
        n = len(WORD.findall(r.text or ""))
        assert r.mix_size == n and r.mix_taken == r.mix_times * n <= 3 * n
        size[r.source] += n
        target[r.source] = r.mix_target
        taken[r.source] += r.mix_taken
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    want, open_ = {}, set(names)
    total = left = sum(size.values())
    while True:  # the excess over three sizes is shared again until none is above
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 3.0 * size[s]
            left -= 3 * size[s]
        open_ -= over
    for s in names:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= 700
    assert sum(want.values()) == pytest.approx(total)
    assert rows_of(mixing.mix_sources(docs), "doc_id", "mix_taken") == sorted(((r.doc_id, r.mix_taken) for r in out), key=repr)
    again = mixing.mixed(docs)
    assert again.columns == docs.columns and again.count() == sum(r.mix_times for r in out)


def test_mixing_prefers_quality(spark):
    rows = [(i, ("good words here " * 10 if i % 2 else "bad### $$$ *** %%% " * 8).strip(), "en", "a" if i < 400 else "b", 0) for i in range(800)]
    out = mixing.mix_sources(spark.createDataFrame(rows, COLUMNS)).filter("source = 'a'").groupBy("doc_id").sum("mix_times").collect()
    good = sum(r[1] for r in out if r[0] % 2)
    assert good > 1.2 * sum(r[1] for r in out if not r[0] % 2)


def test_imatch_equal_texts_and_edits(spark, docs):
    out = imatch.fingerprint(docs).collect()
    assert len(out) == docs.count()
    by_id = defaultdict(set)
    for r in out:
        by_id[r.doc_id].add(r.fingerprint)
    assert len(by_id[1003]) == 1 and by_id[1003] == by_id[30] and by_id[1001] == by_id[1002] == by_id[1004]


def test_imatch_query(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = sorted(imatch.op2(spark, str(tmp_path)).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    texts = [t or "" for _, t in sorted(corpus(), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))]
    assert len(out) == len(texts)
    for k, (r, t) in enumerate(zip(out, texts, strict=True)):
        n = len(t) // 4
        edited = t[: len(t) - n] + texts[(k + 1) % len(texts)][:n]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        assert (r.fingerprint == r.edited_fingerprint) <= (r.near_edited == 1)
    long = [r for r in out if r.n_chars > 400 and r.doc_id not in (1005, 1006)]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.8


def test_classifier_learns_and_ignores_other_columns(spark):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(700):
        bad = r.random() < 0.3
        ws = ["".join(r.choices("aeioulmnrst", k=r.randint(2, 8))) for _ in range(r.randint(5, 60))]
        rows.append((i, " ".join(w.upper() + "!!" if bad else w for w in ws), "en", "s", 0))
        labels.append((i, 0 if bad else 1, 0))
    rows.append((9000, None, None, None, None))
    rows.append((None, "", None, None, None))
    docs, marks = spark.createDataFrame(rows, COLUMNS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(docs, marks)
    out = {x.doc_id: x for x in quality.scored(docs, model).collect()}
    held = [i for i, *_ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 80
    assert np.mean([(out[i].score >= 0.3) == (labels[i][1] == 1) for i in held]) > 0.95
    assert 0 <= out[9000].score <= 1 and out[9000].score == out[None].score
    flipped = marks.selectExpr("doc_id", f"case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality", "toxic")
    assert np.array_equal(quality.fit(docs, flipped)[0], model[0])
    assert quality.fit(docs.limit(0), marks)[1] == 0.0
    assert quality.accepted(docs, marks).columns == docs.columns


def jaccard_groups(rows):
    sets, up = {}, {}
    for k, (_, t) in enumerate(rows):
        ws = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(t or "")]
        sets[k] = frozenset(tuple(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))) if ws else frozenset()
        up[k] = k

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    least = {}
    ids = [-1 if i is None else i for i, _ in rows]
    for k in sets:
        least[root(k)] = min(least.get(root(k), 10**9), ids[k])
    return sorted((ids[k], len(sets[k]), least[root(k)] if sets[k] else ids[k]) for k in sets)


def family(seed, n, words, change):
    r = random.Random(seed)
    base = [f"w{r.randrange(400)}" for _ in range(words)]
    out = []
    for i in range(n):
        ws = list(base)
        for _ in range(r.randint(0, change)):
            ws[r.randrange(len(ws))] = f"z{r.randrange(50)}"
        out.append((5000 + 7 * i, " ".join(ws)))
    return out


@pytest.mark.parametrize("limit", [jaccard.REGION_SHINGLES, 3000])
def test_jaccard_join_matches_brute_force(spark, limit, monkeypatch):
    monkeypatch.setattr(jaccard, "PIVOTS", 4)
    rows = corpus(2) + family(3, 90, 150, 6) + family(4, 40, 30, 2)
    out = jaccard.similar_groups(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, c long"), limit=limit)
    assert rows_of(out, "doc_id", "n_shingles", "component_id") == sorted(jaccard_groups(rows), key=repr)


def test_jaccard_region_recursion():
    r = np.random.default_rng(5)
    sets = []
    for k in range(12):
        base = r.integers(0, 2**63, 200, dtype=np.uint64)
        sets += [np.unique(np.concatenate([base[: 200 - (j % 30)], r.integers(0, 2**63, j % 30, dtype=np.uint64)])) for j in range(20)]
    a, b = (jaccard.Sets([x.tobytes() for x in sets]) for _ in range(2))
    a.join(np.arange(len(sets)))
    b.pairs(np.arange(len(sets)))
    assert np.array_equal(a.roots(np.arange(len(sets))), b.roots(np.arange(len(sets))))
    assert a.regions and a.windows >= 0


def test_components(spark):
    r = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 60) if k != 30] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)]
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(31)) and all(got[k] == 31 for k in range(31, 61))
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
    for a, b in edges:
        if a != b:
            assert got[a] == got[b]


def test_one_of_each(spark):
    rows = [(1, "a b c d e f g h", "x"), (2, "a b c d e f g h", "y"), (1, "a b c d e f g h", "x"), (3, "other words in here now", "z"), (4, None, "n")]
    out = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, kept_ string"))
    assert rows_of(out, "doc_id") == [(1,), (3,), (4,)] and out.columns == ["doc_id", "text", "kept_"]


def test_licences_found_and_told_apart(spark):
    texts = ["Some words.\nLicensed under the Apache License, Version 2.0.\nMore.", "Licensed under CC BY-NC 4.0.", "licensed under CC BY 4.0", "This work is licensed under the GNU General Public License, version 2.", "No notice.", None, "",
             "Text first. " * 200 + "Released under the MIT License.\nAll rights reserved.", "Our licence policy is long and unrelated to wordings of notices."]
    out = rows_of(licences.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "doc_id", "license", "exact")
    assert out == [(0, "Apache-2.0", True), (1, "CC-BY-NC-4.0", True), (2, "CC-BY-4.0", True), (3, "GPL-2.0", True), (7, "All-rights-reserved", True), (7, "MIT", True)]


def test_best_fit_decreasing_is_that_of_single_pieces():
    r = random.Random(9)
    for _ in range(30):
        limit = r.choice([16, 50, 128])
        histogram = Counter(r.randint(1, limit) for _ in range(r.randint(1, 200)))
        plan = packing.best_fit_decreasing(dict(histogram), limit)
        used = defaultdict(list)
        for length in histogram:
            own = sorted(p for p in plan if p[0] == length)
            for rank in range(histogram[length]):
                _, first_rank, first, each, offset = [p for p in own if p[1] <= rank][-1]
                past = rank - first_rank
                used[first + past // each].append((offset + past % each * length, length))
        for spans in used.values():
            at = 0
            for s, n in sorted(spans):
                assert s == at
                at += n
            assert at <= limit
        rooms = []
        for length in sorted(histogram.elements(), reverse=True):
            fit = [i for i, x in enumerate(rooms) if x >= length]
            if fit:
                i = min(fit, key=lambda i: (rooms[i], i))
                rooms[i] -= length
            else:
                rooms.append(limit - length)
        assert len(used) == len(rooms)


def test_packing_round_trip(docs, none):
    from tokenizers import Tokenizer

    special = docs.sparkSession.createDataFrame([(7777, "a <|endoftext|> b", "en", "s", 1)], COLUMNS)
    docs = docs.union(special)
    out = packing.pack_documents(docs, keep_ids=True).collect()
    tokenizer = Tokenizer.from_file(packing.default_tokenizer_path())
    want = Counter()
    for r in docs.collect():
        want[(r.doc_id, np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4").tobytes())] += 1
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in out:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length <= 4 * 2048
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    got = Counter()
    for doc_id, own in pieces.items():
        own.sort(key=lambda r: (r.piece, r.start))
        copies = sum(r.piece == 0 for r in own)
        got[(doc_id, b"".join(r.ids for r in own[::copies]))] += copies
    assert got == want
    for spans in sequences.values():
        assert all(s + n == t for (s, n), (t, _) in zip(sorted(spans), sorted(spans)[1:], strict=False)) and sum(n for _, n in spans) <= 2048 and min(spans)[0] == 0
    assert packing.pack_documents(none).count() == 0


def test_nearest_recall_ties_and_bad_vectors(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(600, 24)) * r.uniform(0.5, 2, (600, 1))
    x[301] = x[300] = x[302]
    rows = [(i, [float(v) for v in x[i]]) for i in range(600)] + [(5000 + i, [float(v) for v in x[40]]) for i in range(60)]
    rows += [(20000, None), (20020, [0.0] * 24), (20040, [float("nan")] * 24), (20060, [None] * 24), (20080, [float("inf")] * 24), (20100, [1.0] * 5)]
    out = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    ids, v = np.array([i for i, _ in rows[:660]]), np.array([e for _, e in rows[:660]])
    hit = total = 0
    got = defaultdict(list)
    for o in out:
        got[o.query_id].append((o["rank"], o.vec_id, o.score))
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    for q in got:
        s = v @ v[ids == q][0]
        s[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -np.round(s, 12)))[:20]]
        mine = sorted(got[q])
        assert [k for k, *_ in mine] == list(range(1, 21)) and all(abs(s[ids == i][0] - z) < 1e-9 for _, i, z in mine)
        hit += len({i for _, i, _ in mine} & set(best.tolist()))
        total += 20
    assert hit / total >= 0.9
    assert nearest.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def removed_by_brute_force(rows):
    data = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(d[j : j + 200] for _, d in data for j in range(len(d) - 199))
    out = []
    for i, d in data:
        gone = np.zeros(len(d), bool)
        for j in range(len(d) - 199):
            if count[d[j : j + 200]] > 1:
                gone[j : j + 200] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(d), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [suffixes.MOST_CONTEXTS, 3])
def test_suffix_dedup_matches_brute_force(spark, most, monkeypatch):
    monkeypatch.setattr(suffixes, "MOST_CONTEXTS", most)
    rows = corpus(6) + family(7, 25, 120, 3)
    out = suffixes.deduplicate(spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, key long"))
    assert rows_of(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == removed_by_brute_force(rows)


def test_loser_tree_merges_front_coded_runs():
    r = random.Random(2)
    for k in (0, 1, 2, 3, 5, 8):
        runs = [sorted(bytes(r.choices(b"ab", k=r.randint(1, 12))) for _ in range(r.randint(0, 30))) for _ in range(k)]
        got = list(suffixes.merged([suffixes.front_coded(x) for x in runs]))
        assert [s for *_, s, _ in got] == sorted(s for x in runs for s in x)
        assert all(n == suffixes.common_prefix(a[2], b[2]) for a, b, n in zip(got, got[1:], [g[3] for g in got[1:]], strict=False))
        assert all(runs[g[0]][g[1]] == g[2] for g in got)


PERSONAL = ["mail anna.smith@mail4.shop.org now", "call +1 (243) 555-5526 or ANNA.SMITH@MAIL4.SHOP.ORG", "host 161.17.88.162 and card 4111 1111 1111 1111", 'token = "ede43f42c939b6405768150e0411590525cf889e"', "Frau Müller met Herr Schmidt and Frau Müller", "ssn 123-45-6789", "Version 2.0. in 1999 had 12345 units", None, ""]


def test_surrogates_keep_form_coreference_and_distinctness(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(PERSONAL)] + [(0, PERSONAL[0], "x"), (None, PERSONAL[2], "x")], "doc_id long, text string, pii_moved string")
    out = {r.doc_id: r for r in pii.surrogate(docs, kinds="kinds").collect()}
    assert out[6].text == PERSONAL[6] and out[7].text is None and out[8].text == ""
    for i in range(6):
        assert out[i].kinds and pii.entities(out[i].text) and [k for *_, k in pii.entities(out[i].text)] == out[i].kinds
        for s, e, _ in pii.entities(PERSONAL[i]):
            assert PERSONAL[i][s:e] not in out[i].text
    mail = re.search(r"\S+@\S+", out[0].text)[0]
    assert re.search(r"\S+@\S+", out[1].text)[0] == mail.upper()
    names = re.findall(r"(?:Frau|Herr) (\w+)", out[4].text)
    assert names[0] == names[2] != names[1] and names[0][0].isupper() and names[0][-1] == "r"
    assert out[None].text == out[2].text


def test_surrogates_are_one_to_one():
    for kind, values in {"ipv4": [f"10.0.{a}.{b}" for a in range(8) for b in range(256)], "phone": [f"1243555{n:04}" for n in range(3000)], "card": [f"411111111111{n:04}" for n in range(3000)], "email": [f"an{a}.{b:02}@mail{c}.example.com" for a in "aeiou" for b in range(100) for c in range(4)], "name": [a + b + "ra" for a in ("ma", "la", "te") for b in ("r", "l", "mi", "sa")]}.items():
        made = {pii.canonical_surrogate(kind, v) for v in values}
        assert len(made) == len(values)
    assert all(pii._check_digit(s[:-1]) == int(s[-1]) for s in [pii.canonical_surrogate("card", "4111111111111111")])


def test_collisions_with_originals_are_moved(spark):
    first = "10.0.0.1"
    meets = pii.canonical_surrogate("ipv4", first)
    docs = spark.createDataFrame([(1, f"a {first} b"), (2, f"c {meets} d")], "doc_id long, text string")
    out = {r.doc_id: r.text.split()[1] for r in pii.surrogate(docs).collect()}
    assert not {first, meets} & set(out.values()) and out[1] != out[2]


def test_html_blocks_and_labeller():
    page = "<html><head><title>x</title><script>if(a<b){}</script></head><body><p>One &amp; two\n three<br>four<p>five<ul><li>six<li>seven</ul><!-- c --><div>e<b>ig</b>ht</div></body>"
    assert [b[0] for b in htmltext.blocks(page)] == ["One & two three four", "five", "six", "seven", "eight"]
    assert htmltext.blocks("") == [] and htmltext.blocks("<p></p>") == []
    model = htmltext.trained(pages=500, epochs=4)
    r, right, total = random.Random(321), 0, 0
    for _ in range(60):
        found = htmltext.blocks(htmltext.training_page(r))
        if found:
            y = np.array(["" in b[0] for b in found])
            z = model.logits([htmltext.inputs([(b[0].replace("", "") or "-", *b[1:]) for b in found])])[0] > 0
            right, total = right + int((y == z).sum()), total + len(y)
    assert right / total > 0.95


def test_labeller_gradients():
    model = htmltext.Labeller()
    pages = [htmltext.inputs(htmltext.blocks(htmltext.training_page(random.Random(k)))) for k in (5, 9)]
    labels = [np.arange(len(p[0])) % 2 * 1.0 for p in pages]

    def loss():
        z = model.logits(pages)
        return sum((np.logaddexp(0, a) - a * b).sum() for a, b in zip(z, labels, strict=True)) / sum(map(len, labels))

    g = model._gradients(pages, labels)
    for name in ("Wf", "Ub", "out", "path", "word", "cb"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        keep, e = model.p[name][at], 1e-5
        model.p[name][at] = keep + e
        up = loss()
        model.p[name][at] = keep - e
        down = loss()
        model.p[name][at] = keep
        assert g[name][at] == pytest.approx((up - down) / (2 * e), rel=1e-3)


def test_html_query_on_rows(spark):
    rows = [(1, "u", "<article><h1>T</h1><p>Some words of the story, told at length.</p></article><footer>&copy; x</footer>", "old"), (2, "v", None, "old"), (3, None, "", "old")]
    out = htmltext.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), model=htmltext.trained(pages=60, epochs=1))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = {r.page_id: r for r in out.collect()}
    assert got[2].text == got[3].text == "" and got[2].n_chars == 0 and got[1].n_chars == len(got[1].text)


def test_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert mixing.mix_sources(none).count() == 0
    assert imatch.fingerprint(none).count() == 0
    assert quality.accepted(none, labels).count() == 0
    assert jaccard.similar_groups(none).count() == 0
    assert licences.scan_licenses(none).count() == 0
    assert suffixes.deduplicate(none).count() == 0
    assert pii.surrogate(none).count() == 0

"""License notices in long lines, several times, by other templates, and against a plain search for exact quotes."""

import random

from tallyloom.llm import licences


def names(text, **options):
    return [(name, exact) for _, _, name, exact, *_ in licences.scan(text, **options)]


def test_notices_in_one_long_line():
    filler = " ".join(random.Random(1).choices("alpha beta gamma released may under the license version delta".split(), k=400))
    text = f"It was released in May. {filler} Distributed. Released under the MIT License. {filler} licensed under CC BY-SA 4.0. {filler}"
    found = licences.scan(text)
    assert [(n, e) for _, _, n, e, *_ in found] == [("MIT", True), ("CC-BY-SA-4.0", True)]
    for start, end, name, *_ in found:
        assert licences.words(text[start:end]) == licences.words(licences.TEMPLATES[name])


def test_a_notice_quoted_twice_gives_two_rows():
    assert names("Released under the MIT License.\nReleased under the MIT License.") == [("MIT", True)] * 2


def test_identifiers_and_changed_words():
    assert names("# SPDX-License-Identifier: GPL-3.0-or-later\nimport os") == [("SPDX:GPL-3.0-or-later", True)]
    assert names("// SPDX-License-Identifier: Apache-2.0") == [("SPDX:Apache-2.0", True)]
    changed = licences.TEMPLATES["ISC"].replace("any purpose", "some purpose")
    found = licences.scan(changed)
    assert [(f[2], f[3], f[5], f[6]) for f in found] == [("ISC", False, ["any"], ["some"])]


def test_every_template_is_found_among_other_words():
    r = random.Random(4)
    for name, wording in licences.known_templates().items():
        around = [" ".join(r.choices("stone river cloud table green seven walk".split(), k=30)) for _ in range(2)]
        assert (name, True) in names(f"{around[0]}. {wording} {around[1]}"), name


def test_other_templates():
    given = (("House", "This work may be redistributed by members of the house only."),)
    assert names("Note: this work may be redistributed by members of the house only. Released under the MIT License.", templates=given) == [("House", True)]


def test_exact_quotes_against_a_plain_search(spark):
    """Every exact row stands at a place where the template's words stand, and every such place has a row that covers it."""
    r = random.Random(7)
    known = {k: licences.words(v) for k, v in licences.TEMPLATES.items()}
    rows = []
    for i in range(60):
        parts = [" ".join(r.choices("stone river cloud license may version".split(), k=r.randint(0, 25))) for _ in range(3)]
        picked = r.sample(list(licences.TEMPLATES), 2)
        rows.append((i, f"{parts[0]} . {licences.TEMPLATES[picked[0]]} {parts[1]}\n{licences.TEMPLATES[picked[1]]} {parts[2]}"))
    out = licences.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = dict(rows)
    for i, text in rows:
        spans = [(x.start, x.end) for x in out if x.doc_id == i and x.exact]
        for x in (x for x in out if x.doc_id == i and x.exact):
            assert licences.words(text[x.start : x.end]) == known[x.license]
        own = [(m.group().lower(), m.start(), m.end()) for m in licences._WORD.finditer(text)]
        for name, template in known.items():
            for k in range(len(own) - len(template) + 1):
                if [w for w, *_ in own[k : k + len(template)]] == template:
                    a, b = own[k][1], own[k + len(template) - 1][2]
                    assert any(s < b and a < e for s, e in spans), (i, name)
    assert len(out) >= 100 and set(texts) == {x.doc_id for x in out}


def test_a_very_long_text():
    text = "license terms apply to all " * 40000 + "Released under the MIT License."
    assert ("MIT", True) in names(text)

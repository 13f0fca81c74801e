"""License scans by conditional compression.

Lines with a word that license texts use, and the lines around them, are candidate blocks. In a block, the places where a
template's rarer words stand in its order are its windows, however long the block's lines are and however often it quotes the
template. A window is compressed alone and with the template as raw zstandard dictionary; windows whose compressed size
shrinks most are what the block most likely quotes, and they are confirmed in that order, word by word: the alignment of
template and window gives the words missing, added and changed, and a version or clause that differs in one word is a
different license. Of windows that overlap, the one with fewer differences stays.

TEMPLATES and SPDX are notices in common use; another table of templates can be given.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Wordings of public license notices. <*> stands for any words (years, holders).
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC0-1.0": "Released into the public domain under CC0 1.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "All-rights-reserved": "All rights reserved.",
}
# Identifiers of the SPDX list that files name in a line of their own.
SPDX = [
    "MIT", "MIT-0", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later",
    "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "ISC", "EPL-2.0", "Zlib", "BSL-1.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0",
]
CUES = r"licen[sc]|copyright|©|rights reserved|public domain|redistribut|hereby granted|spdx|\bcc[ -]?(by|0)\b"
_CUE = re.compile(CUES, re.IGNORECASE)
_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
#: A window's winner saves at least this share of the size that the template has compressed by itself.
LEAST_SAVING = 0.4
#: A confirmed winner has at most this share of its words missing or changed.
MOST_CHANGED = 0.2
#: A window has this share of the template's words, and two words, before and after it.
SLACK = 0.2
#: So many of a template's words, those that are rarest in the block, say where it may stand.
MARKS = 3
LEVEL = 3


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def known_templates() -> dict[str, str]:
    return TEMPLATES | {f"SPDX:{i}": f"SPDX-License-Identifier: {i}" for i in SPDX}


@lru_cache(4)
def _compiled(templates: tuple[tuple[str, str], ...]) -> list[tuple]:
    """(name, words, compressor with the template as dictionary, compressed size of the template)."""
    import zstandard as z

    out = []
    for name, text in templates:
        data = _canonical(words(text)).encode()
        given = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
        out.append((name, words(text), z.ZstdCompressor(level=LEVEL, dict_data=given), len(z.ZstdCompressor(level=LEVEL).compress(data))))
    return out


def _canonical(own: list[str]) -> str:
    return " " + " ".join(own) + " "


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of candidate blocks: maximal runs of lines not further than one line from a line with a cue; whole texts count."""
    spans, at = [], 0
    for line in text.split("\n"):
        spans.append((at, at + len(line)))
        at += len(line) + 1
    near: list[int] = []
    for i, (s, e) in enumerate(spans):
        if _CUE.search(text, s, e):
            near += [k for k in (i - 1, i, i + 1) if 0 <= k < len(spans) and (not near or k > near[-1])]
    start = None
    for i, k in enumerate(near):
        if start is None:
            start = spans[k][0]
        if i + 1 == len(near) or near[i + 1] != k + 1:
            yield start, spans[k][1]
            start = None


def places(template: list[str], at: Mapping[str, list[int]], n: int) -> list[tuple[int, int]]:
    """(first, end) of the windows of a block of n words, whose words' positions are at, in which the template may stand."""
    m, slack = len(template), max(2, int(SLACK * len(template)))
    here = Counter(template)
    marks = sorted((w for w in here if w in at), key=lambda w: len(at[w]))[:MARKS]
    if len(marks) < min(MARKS, len(here)) and len(marks) < (1 - MOST_CHANGED) * len(here):
        return []
    starts = sorted({p - i for w in marks for i, t in enumerate(template) if t == w for p in at[w]})
    out: list[tuple[int, int]] = []
    last = None
    for s in starts:
        if last is None or s - last > slack:
            out.append((max(0, s - slack), min(n, s + m + slack)))
        else:
            out[-1] = (out[-1][0], min(n, s + m + slack))
        last = s
    return out


def difference(template: list[str], block: list[str]) -> tuple[list[str], list[str], int, int]:
    """Words of the template that the block lacks or changes, those that the block has between the template's, and where it begins and ends."""
    matches = [m for m in SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks() if m.size]
    missing, added, a = [], [], 0
    for i, m in enumerate(matches):
        missing += template[a : m.a]
        if i:
            added += block[matches[i - 1].b + matches[i - 1].size : m.b]
        a = m.a + m.size
    return missing + template[a:], added, matches[0].b if matches else 0, matches[-1].b + matches[-1].size if matches else 0


def scan(text: str, templates: tuple[tuple[str, str], ...] | None = None) -> list[tuple]:
    """(start, end, license, exact, saving, missing, added) of each confirmed license of a text, as often as it is quoted."""
    import zstandard as z

    found = []
    plain = z.ZstdCompressor(level=LEVEL)
    for start, end in blocks(text):
        spans = [(m.start(), m.end()) for m in _WORD.finditer(text, start, end)]
        block = [text[a:b].lower() for a, b in spans]
        at: dict[str, list[int]] = {}
        for i, w in enumerate(block):
            at.setdefault(w, []).append(i)
        windows = []
        for name, template, compressor, size in _compiled(templates or tuple(known_templates().items())):
            for first, last in places(template, at, len(block)):
                data = _canonical(block[first:last]).encode()
                saving = (len(plain.compress(data)) - len(compressor.compress(data))) / size
                if saving >= LEAST_SAVING:
                    windows.append((-saving, first, last, name, template))
        good = []
        for saving, first, last, name, template in sorted(windows):
            missing, added, a, b = difference(template, block[first:last])
            if b > a and len(missing) <= MOST_CHANGED * len(template) and len(added) <= max(2, MOST_CHANGED * len(template)):
                good.append((len(missing) + len(added), -len(template), first + a, first + b, name, -saving, missing, added))
        taken: list[tuple[int, int]] = []
        for changes, _, a, b, name, saving, missing, added in sorted(good):
            if any(a < y and x < b for x, y in taken):
                continue
            taken.append((a, b))
            found.append((spans[a][0], spans[b - 1][1], name, changes == 0, saving, missing, added))
    return sorted(found)


SCHEMA = "start int, end int, license string, exact boolean, saving double, missing array<string>, added array<string>"


def scan_licenses(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", templates: Mapping[str, str] | None = None) -> DataFrame:
    """One row a license notice found: doc_id and SCHEMA (code points; words lower-cased). Null and empty texts have none.

    templates: {name: wording}, in place of known_templates().

    Only texts with a cue, looked for in the JVM over the whole text, reach Python. Repeated rows give repeated results.
    """
    given = tuple((templates or known_templates()).items())
    few = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.lower("text").rlike(CUES))
    kind = few.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string())]
        for batch in batches:
            rows = [(i, *r) for i, t in enumerate(batch.column(1).to_pylist()) for r in scan(t, given)]
            columns = list(zip(*rows, strict=True)) or [()] * 8
            names = ["doc_id", *[c.split()[0] for c in SCHEMA.split(", ")]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int32()))] + [pa.array(c, t) for c, t in zip(columns[1:], types, strict=True)], names)

    return few.mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))

"""Contexts of crowded grams come out of the sort as their own bytes: documents are moved once for the suffixes, however crowded they are."""

import random

from tallyloom.llm import suffixes


def removed(texts):
    """Bytes that stay, by brute force."""
    data = [t.encode() for t in texts]
    places = {}
    for i, d in enumerate(data):
        for k in range(len(d) - suffixes.SPAN + 1):
            places.setdefault(d[k : k + suffixes.SPAN], []).append((i, k))
    gone = [bytearray(len(d)) for d in data]
    for where in places.values():
        for i, k in where if len(where) > 1 else []:
            gone[i][k : k + suffixes.SPAN] = b"\1" * suffixes.SPAN
    return [sum(g) for g in gone]


def test_documents_are_not_moved_again_for_crowded_grams(spark, monkeypatch):
    r = random.Random(4)
    line = "".join(r.choice("abcdefgé ") for _ in range(170))
    texts = ["".join(r.choice("abcdefgé ") for _ in range(r.randint(0, 90))) + line + "".join(r.choice("xyzü") for _ in range(r.randint(1, 60))) for _ in range(30)]
    texts += [t[5:] + "!" for t in texts[:8]] + texts[:2]
    moved, plain = [], suffixes._with_text

    def counted(docs, contexts):
        moved.append(docs.schema["text"].dataType.simpleString())
        return plain(docs, contexts)

    monkeypatch.setattr(suffixes, "MOST_CONTEXTS", 3)
    monkeypatch.setattr(suffixes, "_with_text", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["n_removed"] for x in suffixes.deduplicate(docs, keep_text=False).collect()}
    assert [got[i] for i in range(len(texts))] == removed(texts) and sum(got.values())
    assert len(moved) > 1 and moved.count("string") == 1

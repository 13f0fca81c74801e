"""Ids of the cached tokenizer are those of the library, for odd white space, letters of any age and special tokens too."""

import random

import pyarrow as pa

from tallyloom.llm import packing


def test_cuts_encode_like_the_library():
    cached = packing.CachedTokenizer(packing.default_tokenizer_path())
    rng = random.Random(3)
    parts = [*"ab cD1 2\n\t .,!'é漢ß\x1c\x85\xa0　<|>½١_\x00", "ll", "  ", " '", "\r\n", "<|endoftext|>", " don't", "Ɤ", "՘"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += [f"{chr(c)}a{chr(c)} {chr(c)}1 {chr(c)}!" for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(texts), packing.ROWS):
        some = texts[at : at + packing.ROWS]
        ids, starts = cached.encode(pa.array(some))
        for t, a, b in zip(some, starts[:-1], starts[1:], strict=True):
            assert ids[a:b].tolist() == cached.tokenizer.encode(t, add_special_tokens=False).ids


def test_an_empty_batch():
    ids, starts = packing.CachedTokenizer(packing.default_tokenizer_path()).encode(pa.array([], pa.string()))
    assert len(ids) == 0 and starts.tolist() == [0]

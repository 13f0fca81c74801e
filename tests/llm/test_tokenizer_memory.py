"""What a task keeps in a Python worker goes with the task."""

import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")

from tallyloom.llm import packing  # noqa: E402


def test_workers_keep_no_words_after_their_tasks(spark):
    docs = spark.range(0, 2000, 1, 4).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 20), k -> concat('w', id * 20 + k))) AS text")
    path = packing.default_tokenizer_path()
    pieces = packing.tokenised_pieces(docs, path, 64, False)
    first = sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in pieces.collect())

    def kept(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [sum(len(t.words) + len(t.cuts) for t in packing._TOKENIZERS.values())]})

    assert {r["n"] for r in spark.range(0, 16, 1, 16).mapInArrow(kept, "n long").collect()} == {0}
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in pieces.collect()) == first

"""The lexicon is far larger than a row, so no step carries it along; a text's hashes are taken once."""

import re

from tallyloom.llm import imatch


def test_steps_carry_no_lexicon(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b"), (3, None), (4, "a b c d")], "doc_id long, text string")
    prints = imatch.fingerprint(docs, band=(0.1, 9.0))
    steps = prints._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert any("slots#" in x for x in steps) and not [x for x in steps if re.search(r"Project \[(.*, )?slots#\d+(, .*)?\]$", x)]
    got = {r["doc_id"]: r["fingerprint"] for r in prints.collect()}
    assert got[1] == got[4] != got[2] and got[3].startswith("=")


def test_texts_get_their_hashes_before_they_are_dealt(spark, tmp_path):
    spark.createDataFrame([(1, "a b c d"), (2, "a b"), (3, None), (4, "a b c d")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = imatch.op2(spark, str(tmp_path))
    steps = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any(re.search(r"Project \[.*\bslots#\d+, ", x) for x in steps)
    near = {r["doc_id"]: (r["near_edited"], r["near_next"]) for r in out.collect()}
    assert near[4][1] == 1.0 and set(near) == {1, 2, 3, 4}  # the first row is the last one's next

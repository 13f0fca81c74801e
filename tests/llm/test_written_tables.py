"""Intermediate tables lie in the shared folder and can be removed."""

import os

from tallyloom.llm import common


def test_written_tables_are_dropped(spark):
    before = len(common._WRITTEN)
    assert common.written(spark.range(3), "kept").count() == 3
    common.written(spark.range(5), "gone")
    kept, gone = (p.removeprefix("file://") for p in common._WRITTEN[before:])
    common.drop_written(spark, before + 1)
    assert os.path.isdir(kept) and not os.path.exists(gone) and len(common._WRITTEN) == before + 1

import corpus_pipeline
from test_operators import COLUMNS, PERSONAL


def test_stages_in_order(spark, tmp_path):
    good = [(i, f"The plain words of story number {i} go on for a while and end here {i * i} {i * 7}.", "en", f"s{i % 3}", 0) for i in range(120)]
    bad = [(1000 + i, " ".join(f"WORD{i}{k}!!" for k in range(30)), "en", "s0", 0) for i in range(60)]
    copies = [(2000 + i, good[i][1], "en", "s1", 0) for i in range(10)]
    private = [(3000, "Well then, " + PERSONAL[1] + " and so it goes on and on.", "en", "s2", 0), (3001, None, "en", None, None)]
    spark.createDataFrame(good + bad + copies + private, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in good] + [(r[0], 0, 0) for r in bad], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")], name
            path = f"{tmp_path}/{k}.parquet"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            kept.append({r.doc_id: r.text for r in docs.collect()})
    assert set(kept[0]) >= {r[0] for r in good} and not set(kept[0]) & {r[0] for r in bad}
    assert not set(kept[1]) & {r[0] for r in copies} and set(kept[1]) >= {r[0] for r in good}
    assert set(kept[2]) == set(kept[1]) and "555-5526" not in kept[2][3000] and kept[2][0] == kept[1][0]
    assert set(docs.columns) >= {"doc_id", "piece", "sequence_id", "offset"}
    assert {r.doc_id for r in docs.collect()} == set(kept[3])

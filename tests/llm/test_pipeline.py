import corpus_pipeline
from factgrid.llm import decontam, jaccard
from factgrid.llm.common import small_batches


def test_stages_in_turn(spark, tmp_path):
    lines = [f"the {w} stone of river{w} and hill{k} was seen by {k} men of town{k * 7 % 13} at night" for k, w in enumerate("abcdefghij" * 4)]
    item = "what is the name of the longest river in this strange land? It is called the Umbra."
    docs = [(k, "\n".join(lines[k : k + 3]), "en", "s", 1) for k in range(30)] + [(40, "too short", "en", "s", 1), (41, f"{lines[39]}\n{item}", None, "s", 1), (42, None, None, None, None), (43, "\n".join(lines[5:8]), "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, table, str(tmp_path))
        if k < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        out.write.parquet(f"{tmp_path}/out{k}")
        table = spark.read.parquet(f"{tmp_path}/out{k}")
        seen.append({r["doc_id"] for r in table.select("doc_id").collect()})
    assert not seen[0] & {40, 42} and 41 in seen[0] and 41 not in seen[3] and seen[1] == seen[0]
    assert seen[4] == seen[3] and {"sequence_id", "offset", "length"} <= set(table.columns)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
    assert decontam.OVERLAP == 0.8 and jaccard.filtered.__defaults__[:2] == (5, 80)


def test_small_batches_leave_settings_of_the_session(spark):
    rows, size = (f"spark.sql.execution.arrow.{x}" for x in ("maxRecordsPerBatch", "maxBytesPerBatch"))
    before = {key: spark.conf.get(key) for key in (rows, size)}
    try:
        spark.conf.unset(size)
        spark.conf.set(rows, "77")
        small_batches(spark)
        assert (spark.conf.get(rows), spark.conf.get(size)) == ("77", "16m")
        spark.conf.unset(rows)
        small_batches(spark)
        assert spark.conf.get(rows) == "1000"
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)

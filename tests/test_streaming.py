from factgrid.streaming import verdicts


def test_claims_in_a_stream(spark, tmp_path):
    edges = spark.createDataFrame([("f", "call", "a", "b", "calls", "call")], "file_id string, graph string, src string, dst string, relationship string, graph_source string")
    said = spark.sql("SELECT 'f' AS file_id, x AS subject, 'b' AS object, timestamp'2024-01-01 00:00:00' AS ts FROM VALUES ('a'), ('c') AS t(x)")
    said.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(said.schema).parquet(f"{tmp_path}/in")
    out = verdicts.windowed_rates(verdicts.direct_verdicts(stream, edges))
    q = out.writeStream.outputMode("complete").format("memory").queryName("rates").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["total_claims"], r["hallucination_rate"]) for r in spark.table("rates").collect()] == [(2, 0.5)]

from strandmill.streaming.streams import append_loads, stream_loads


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([("TTAGGGTGAGGGTTAGGG" * 10, 180), (None, 5)], "query_sequence string, centered_query_end int")
    rows.write.parquet(str(tmp_path / "in"))
    batch = sorted(str(r.load) for r in stream_loads(rows).collect())
    append_loads(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(str(r.load) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == batch == ["0", "60"]

from pyspark.sql import functions as F

from riskloom.streaming import ledger


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i % 24:02d}:{i % 60:02d}:00", "ab"[i % 2], float(i)) for i in range(300)]
    table = spark.createDataFrame(rows, "event_id long, t string, kind string, value double").select("event_id", F.to_timestamp("t").alias("ts"), "kind", "value")
    table.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    counts = ledger.windowed(stream, "ts", ["kind"], "value")
    query = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    want = ledger.windowed(table, "ts", ["kind"], "value")
    key = lambda r: (r.window_start, r.kind)
    assert sorted(spark.table("counts").collect(), key=key) == sorted(want.collect(), key=key)


def test_repeated_events_are_dropped(spark, tmp_path):
    table = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:01:00")], "event_id long, t string").select("event_id", F.to_timestamp("t").alias("ts"))
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    ledger.run_available(ledger.distinct_events(stream, "ts", "event_id", "10 minutes"), str(tmp_path / "out"), str(tmp_path / "check"))
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]
    assert ledger.distinct_events(table, "ts", "event_id").count() == 2

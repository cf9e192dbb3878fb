"""Incremental ingest, and windows of a stream against the same windows of a batch."""

import datetime as dt

from lakelineage.streaming import events as streams

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double"


def rows_of(first, n):
    return [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i), i % 3, "ab"[i % 2], float(i)) for i in range(first, first + n)]


def test_ingest_takes_each_file_once(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = spark.createDataFrame([], EVENT).schema
    spark.createDataFrame(rows_of(0, 20), EVENT).write.parquet(source)
    for n in (20, 20, 50):
        if n == 50:
            spark.createDataFrame(rows_of(20, 30), EVENT).write.mode("append").parquet(source)
        streams.ingest(spark, source, schema, target, state).awaitTermination()
        got = spark.read.parquet(target)
        assert got.count() == got.select("event_id").distinct().count() == n


def test_stream_windows_equal_batch_windows(spark, tmp_path):
    batch = spark.createDataFrame(rows_of(0, 60), EVENT)
    batch.write.parquet(str(tmp_path / "in"))
    # A late mark far ahead closes the windows before it.
    spark.createDataFrame([(999, dt.datetime(2024, 2, 1), 7, "z", 0.0)], EVENT).write.parquet(str(tmp_path / "later"))
    for name, make in (("windows", streams.per_window), ("sessions", streams.sessions)):
        for part in ("in", "later"):
            stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / part))
            assert make(stream).isStreaming
        both = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1000).option("recursiveFileLookup", "true").parquet(str(tmp_path))
        query = make(both).writeStream.format("memory").queryName(f"{name}_seen").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        seen = {tuple(r) for r in spark.table(f"{name}_seen").collect()}
        assert seen <= {tuple(r) for r in make(batch.unionByName(spark.read.schema(batch.schema).parquet(str(tmp_path / "later")))).collect()}
        assert seen == {tuple(r) for r in make(batch).collect()}

"""Extensions: incremental ingest and windows over an event stream. The batch form of a window gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def ingest(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str) -> StreamingQuery:
    """Append files of ``source`` that weren't seen yet to ``target``, then stop."""
    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def per_window(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their value by type and window; of a stream, or of a batch."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    counted = rows.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("value"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of users: runs of events that are less than ``gap`` apart."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    counted = rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")

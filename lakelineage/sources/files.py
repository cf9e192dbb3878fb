"""Text files as rows, and tables as files or catalog entries."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType


#: Of files whose names Spark's listing hides; they are read on the driver, so there is a bound.
MOST_HIDDEN_BYTES = 64 << 20


def hidden_texts(spark: SparkSession, *paths: str) -> list[tuple[str, str]]:
    """Files whose names begin with ``_`` or ``.``, which Spark's readers pass over; small definition files, read here."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found, size = [], 0
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        for status in fs.globStatus(path) or ():
            for s in fs.listStatus(status.getPath()) if status.isDirectory() else (status,):
                if s.isFile() and s.getPath().getName()[0] in "_.":
                    size += s.getLen()
                    if size > MOST_HIDDEN_BYTES:
                        raise ValueError(f"files with hidden names have over {MOST_HIDDEN_BYTES} bytes; rename them")
                    stream = fs.open(s.getPath())
                    found.append((s.getPath().toString(), jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
                    stream.close()
    return found


def texts(spark: SparkSession, *paths: str) -> DataFrame:
    """``file``, ``text``: a row per file, hidden names too, without a leading byte-order mark."""
    rows = spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    if hidden := hidden_texts(spark, *paths):
        rows = rows.unionByName(spark.createDataFrame(hidden, "file string, value string"))
    return rows.select("file", F.regexp_replace("value", "^﻿", "").alias("text"))


def lines(files: DataFrame) -> DataFrame:
    """``file``, ``pos``, ``line``: the lines of each text in order."""
    return files.select("file", F.posexplode(F.split("text", "\r?\n", -1)).alias("pos", "line"))


def blocks(rows: DataFrame, header: str) -> DataFrame:
    """``rows`` with ``block``: the position of the last line at or before a line that matches ``header``."""
    here = F.when(F.col("line").rlike(header), F.col("pos"))
    return rows.withColumn("block", F.last(here, ignorenulls=True).over(Window.partitionBy("file").orderBy("pos")))


def nanosecond_columns(spark: SparkSession, path: str) -> dict[str, bool]:
    """Top-level columns of the Parquet files at ``path`` that hold nanoseconds, and whether those are in UTC.

    Files are listed by Spark and their footers read in its tasks; file contents are not read. Footers are opened by
    pyarrow, which knows local, hdfs, s3, gs and abfs paths.
    """

    def footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for uri in batch["path"]:
                fs, name = pa.fs.FileSystem.from_uri(uri)
                with fs.open_input_file(name) as file:
                    schema = pq.read_schema(file)
                found += [(f.name, f.type.tz is not None) for f in schema if pa.types.is_timestamp(f.type) and f.type.unit == "ns"]
            yield pd.DataFrame(sorted(set(found)), columns=["name", "utc"])

    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select("path")
    rows = listed.mapInPandas(footers, "name string, utc boolean").distinct().collect()  # a row per column at most, or two
    mixed = [n for n, k in Counter(r.name for r in rows).items() if k > 1]
    if mixed:
        raise ValueError(f"columns in UTC in some files and without zone in others: {', '.join(sorted(mixed))}")
    return {r.name: r.utc for r in rows}


def landing(spark: SparkSession, path: str, nanos: dict[str, bool] | None = None) -> DataFrame:
    """A landing Parquet table; nanosecond timestamps, which Spark doesn't read, become timestamps.

    ``nanos``: names of such columns and whether they are in UTC; by default they are found in the files' footers. Where
    there are any, the session reads nanoseconds as long from then on.
    """
    nanos = nanosecond_columns(spark, path) if nanos is None else nanos
    if nanos:
        spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    return timestamps(spark.read.option("datetimeRebaseMode", "CORRECTED").option("int96RebaseMode", "CORRECTED").parquet(path), nanos)


def timestamps(df: DataFrame, nanos: dict[str, bool] | None = None) -> DataFrame:
    """Timestamps without zone become timestamps; so do the long columns ``nanos`` (name, and whether in UTC).

    Whole microseconds are kept exactly, by integer arithmetic; what a column has beyond them is cut off towards the past.
    Times without zone are of the session's zone.
    """
    plain = {f.name: F.col(f.name).cast("timestamp") for f in df.schema if isinstance(f.dataType, TimestampNTZType)}
    micros = lambda c: F.timestamp_micros(F.floor(F.col(c).cast("decimal(20,0)") / 1000).cast("long"))
    return df.withColumns(plain | {c: micros(c) if utc else F.to_utc_timestamp(micros(c), F.current_timezone()) for c, utc in (nanos or {}).items()})


def checked(df: DataFrame, name: str) -> DataFrame:
    """``df``, if it has columns and rows; reads one row at most."""
    if not df.columns:
        raise ValueError(f"{name} has no columns")
    if df.isEmpty():
        raise ValueError(f"{name} has no rows")
    return df

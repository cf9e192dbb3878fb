"""Helpers shared by the text operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as the contracts define them: runs of anything but space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share; a local session that names none gets one of its own."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local["):
        raise ValueError("a cluster session needs spark.checkpoint.dir, a folder that all executors share")
    return (top or tempfile.mkdtemp(prefix="checkpoint-")).rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through :func:`shared_folder`, so that a lost executor costs no data."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def session_path(spark: SparkSession, name: str) -> str:
    """A path in :func:`shared_folder` that nothing uses yet; what is written there goes when the session ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def parallelism(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


def word_count(text: str | Column) -> Column:
    """Number of words of a text; null and empty texts have none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a variant of it that no column of ``df`` has (column names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph with long node ids.

    ``edges``: columns ``a`` and ``b``. Returns ``id`` and ``component_id`` (the smallest id reachable) for the ids in
    ``edges`` whose component has a smaller id than their own. Alternates two steps until nothing changes: every node
    sends its larger neighbours to the smallest node it sees, then every node links its smaller neighbours to the
    smallest. Each step is a ``min`` aggregation (combined before the shuffle) and a join on the node; no
    neighbourhood is collected. The number of rounds grows with the logarithm of the longest path.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = checkpoint(e)  # a > b
    before = mark(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = checkpoint(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        after = mark(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("id"), F.col("b").alias("component_id"))


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage by a Parquet table in :func:`shared_folder`; it goes when the session ends.

    Smaller than a checkpoint, and read by column.
    """
    path = session_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Cutting the lineage of iterative plans, and numbering rows without bringing them together."""

from __future__ import annotations

from collections.abc import Sequence
import tempfile

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the folder in ``spark.checkpoint.dir``; a local session that names none gets a folder of its own."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("a cluster session needs spark.checkpoint.dir, a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def cut_counted(df: DataFrame, where: Column | None = None) -> tuple[DataFrame, int]:
    """:func:`cut`, and the number of rows (for which ``where`` holds), counted by the job that writes them."""
    seen = Observation()
    done = cut(df.observe(seen, F.count_if(F.lit(True) if where is None else where).alias("n")))
    return done, seen.get["n"]


# Fixed value: rows of short texts that go to every task of a join; what has more is shuffled.
FEW = 50_000


def beside(df: DataFrame, n: int) -> DataFrame:
    """``df`` of ``n`` rows as a side of a join. Spark's estimates don't know what explodes and aggregates make of a
    compressed file, and would send large sides through the driver."""
    return F.broadcast(df) if n <= FEW else df.hint("merge")


def ranks(rows: DataFrame, column: str) -> DataFrame:
    """Distinct values of ``column`` with ``rank`` and ``dense_rank``: as over all rows, largest first and nulls last.

    Values are counted first, so that equal ones never meet in one task, then cut into ranges and numbered within their
    range; what is in the ranges before is added. Only two numbers per range are brought together.
    """
    n = rows.sparkSession.sparkContext.defaultParallelism
    order = F.col(column).desc_nulls_last()
    values = rows.groupBy(column).agg(F.count("*").alias("_n"))
    parts = cut(values.repartitionByRange(n, order).withColumn("_part", F.spark_partition_id()))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over a row per range
    sizes = parts.groupBy("_part").agg(F.sum("_n").alias("_rows"), F.count("*").alias("_values"))
    before = sizes.select("_part", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_rows"), F.coalesce(F.sum("_values").over(ahead), F.lit(0)).alias("_values"))
    within = Window.partitionBy("_part").orderBy(order)
    placed = parts.withColumn("_upto", F.sum("_n").over(within)).withColumn("_nth", F.row_number().over(within)).join(F.broadcast(before), "_part")
    return placed.select(column, (F.col("_rows") + F.col("_upto") - F.col("_n") + 1).cast("int").alias("rank"), (F.col("_values") + F.col("_nth")).cast("int").alias("dense_rank"))


def ranked(rows: DataFrame, column: str, name: str, dense: bool = False) -> DataFrame:
    """``rows`` with their rank by ``column`` as ``name``, as :func:`ranks` has it."""
    found = ranks(rows, column).select(F.col(column).alias("_value"), F.col("dense_rank" if dense else "rank").alias(name))
    return rows.join(found, F.col(column).eqNullSafe(F.col("_value"))).drop("_value")

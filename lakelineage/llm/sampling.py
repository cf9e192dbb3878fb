"""Bounded, repeatable samples of labelled rows for training on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str | Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 2 when divided by 4. A null id is not held out."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


#: Labels that a sample may have; their counts are sent to every task.
MOST_LABELS = 10_000


def labelled_sample(rows: DataFrame, label: str, per_label: int, *key: str) -> DataFrame:
    """About ``per_label`` rows of each label, chosen by a hash of ``key``, so that reruns take the same rows.

    Labels are counted first; the share taken of each is ``per_label / count``. The counts, of MOST_LABELS labels at
    most, are broadcast, so that no texts are shuffled and no label's rows meet in one task.
    """
    counts = rows.groupBy(label).agg(F.count("*").alias("_n")).withColumnRenamed(label, "_label").limit(MOST_LABELS + 1).collect()
    if len(counts) > MOST_LABELS:
        raise ValueError(f"{label} has over {MOST_LABELS} values")
    schema = f"_label {rows.schema[label].dataType.simpleString()}, _n long"
    small = rows.sparkSession.createDataFrame([tuple(r) for r in counts], schema)
    even = F.pmod(F.xxhash64(F.lit(29), *key), F.lit(1 << 40)) / float(1 << 40)
    return rows.join(F.broadcast(small), F.col(label) == F.col("_label")).where(even * F.col("_n") < per_label).drop("_label", "_n")

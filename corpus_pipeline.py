"""Training corpus from ``documents``: five stages, each of them one text operator.

Toxic documents go, repeated lines go, one document of each group of near duplicates stays, documents that hold a
benchmark item go, and sources are mixed to their target weights. Each stage's result is written as Parquet and read
again, so that the next stage starts from files and a lost executor costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelineage.llm import decontaminate, line_dedup, minhash_dedup, mixing, toxicity
from lakelineage.llm.common import session_path, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold. The network learns from the labels of ``documents`` in ``sf_dir``."""
    net = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, net).where(F.col("predicted") == 0).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without repeated lines; ``n_chars`` is of the new text."""
    fewer = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return fewer.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 or more of its five-word shingles."""
    return minhash_dedup.drop_near_duplicates(docs).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time that a document goes in, with ``size``, ``source_size``, ``target``, ``taken`` and ``copy``."""
    return mixing.copies(mixing.mix(docs.select(*COLUMNS)))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("minhash_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: A trained network and similarity joins can't be said in SQL; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each writes goes to the folder in ``spark.checkpoint.dir``, until the session ends."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = session_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)

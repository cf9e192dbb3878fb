"""Mixing sources to target weights by Pareto order sampling.

Each source has a target in words. A document of a source whose target is ``m`` times its size goes in ``floor(m)``
times for certain; for the rest of the target, each document has an inclusion probability, in proportion to a weight
(the square root of its size by default, so that long documents are preferred but don't fill the mix), such that the
expected words are the rest. Where that gives a probability of 1 or more, the document is taken for certain and what is
left is shared anew among the others, until no probability reaches 1. Documents are ranked by ``u / (1 - u)`` divided by
the odds of their probability (Pareto order sampling), and taken in that order until the rest is reached.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakelineage.llm.common import checkpoint, free_name, word_count

#: Ranks are cut into so many equal bins; only the bin in which a source's target falls is sorted.
BINS = 4096
MOST_SENT = 100_000  # sources whose targets are sent to every task; those of more sources are joined by a shuffle


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Target of each source: ``share`` of all words, dealt by weight, none above ``most`` times its source's words.

    ``sizes``: ``source``, ``source_size``, one row per source. Sources take the ``weights`` in turn, by code point,
    null last. What a source can't take goes to the others by weight: with sources ordered by ``limit / weight``, those
    that stop at their limit come first, so one running sum finds them all. The window runs over one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    dealt = sizes.withColumn("_w", weight).withColumn("_limit", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("_limit") / F.col("_w"), F.col("source").isNull(), F.encode("source", "utf-8"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / (
        F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    )
    leveled = dealt.withColumn("_level", level).withColumn("_full", F.col("_limit") <= F.col("_w") * F.col("_level"))
    final = F.max(F.when(~F.col("_full"), F.col("_level"))).over(everything)  # of the first that isn't full; it falls after that
    target = F.when(F.col("_full"), F.col("_limit")).otherwise(F.least(F.col("_limit"), F.col("_w") * F.col("_final")))
    return leveled.withColumn("_final", final).select("source", "source_size", target.alias("target"))


def certain(steps: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` (``source``, ``_rest``) with ``_sure``, the least weight of documents taken for certain, and what the others share.

    ``steps``: ``source``, ``_weight``, ``_words``, ``_mass`` (words times weight), a row per source and distinct weight, which are
    as many as distinct sizes by default. From the largest weight down, a weight is certain while its share of what is
    left, ``left * weight / mass left``, is 1 or more; that is the set that taking and sharing anew, again and again, ends at.
    """
    rows = steps.join(targets.select(F.col("source").alias("_s"), "_rest"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    down = Window.partitionBy("source").orderBy(F.desc("_weight"))
    upto = down.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("source")
    left = F.col("_rest") - (F.sum("_words").over(upto) - F.col("_words"))
    mass = (F.sum("_mass").over(whole) - F.sum("_mass").over(upto) + F.col("_mass")).cast("double")
    here = (F.col("_weight") > 0) & (left > 0) & (left * F.col("_weight") >= mass)
    rows = rows.withColumn("_here", here).withColumn("_in", F.min(F.col("_here").cast("int")).over(upto) == 1)
    out = rows.groupBy("source").agg(
        F.min(F.when(F.col("_in"), F.col("_weight"))).alias("_sure"), F.coalesce(F.sum(F.when(F.col("_in"), F.col("_words"))), F.lit(0)).alias("_taken"),
        F.coalesce(F.sum(F.when(~F.col("_in"), F.col("_words"))), F.lit(0)).alias("_open"), F.coalesce(F.sum(F.when(~F.col("_in"), F.col("_mass"))).cast("double"), F.lit(0.0)).alias("_total"),
    )
    both = targets.join(out.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    return both.withColumn("_rest", F.col("_rest") - F.col("_taken")).drop("_taken")


def small(by_source: DataFrame) -> DataFrame:
    """Rows of a source each, stored, sent to every task unless they are too many; so no texts are shuffled to meet them."""
    return F.broadcast(by_source) if by_source.limit(MOST_SENT + 1).count() <= MOST_SENT else by_source


def mix(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17, inclusion: Column | None = None
) -> DataFrame:
    """``docs`` (``doc_id``, ``text``, ``source``, any more) with ``size``, ``source_size``, ``target`` and ``taken``.

    ``taken``: words that the mix takes of the document, repeats counted, a multiple of its size. ``inclusion``:
    weight that a document's inclusion probability is in proportion to, among those of its source (by default the square
    root of its size); nulls count as 1, and probabilities stop short of 1.

    Defined cases: a null text has size 0 and is never taken; null is a source of its own, the last; rows with the same
    id are separate documents that draw different numbers unless all their columns agree, and of equal rows any one is
    taken; an empty table gives an empty result; columns of ``docs`` with the names of results are replaced. Reruns
    agree: the random number is a hash of id, text and seed.
    """
    added = ("size", "source_size", "target", "taken")
    rows = docs.drop(*[c for c in docs.columns if c.lower() in added])
    u = (F.pmod(F.col("_h"), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    weight = F.sqrt("size") if inclusion is None else F.greatest(F.lit(0.0), F.coalesce(inclusion.cast("double"), F.lit(1.0)))
    rows = rows.withColumn("size", word_count("text")).withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "text")).withColumn("_u", u).withColumn("_weight", weight)
    # Sums of weights as decimals, so that no order of adding changes them.
    steps = checkpoint(rows.groupBy("source", "_weight").agg(F.sum("size").alias("_words"), F.sum((F.col("size") * F.col("_weight")).cast("decimal(38,6)")).alias("_mass")))
    sizes = checkpoint(steps.groupBy("source").agg(F.sum("_words").alias("source_size")))
    targets = source_targets(sizes, weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("_whole", whole).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    targets = certain(steps, targets).withColumn("_p", F.when(F.col("_open") > 0, F.col("_rest") / F.col("_open")).otherwise(F.lit(0.0))).drop("_open")
    targets = checkpoint(targets)  # one row per source

    # The rank: random odds over inclusion odds. q / (1 + q) lies in (0, 1), in the same order, and is easy to bin.
    bounded = lambda p: F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    p, own = bounded(F.col("_p")), bounded(F.coalesce(F.try_divide(F.col("_rest") * F.col("_weight"), F.col("_total")), F.lit(0.0)))
    q = (F.col("_u") / (1 - F.col("_u"))) / (own / (1 - own))
    ranked = (
        rows.join(small(targets.withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source")
        .withColumn("_q", q / (1 + q))
        # q / (1 + q) is far from even within a source; times the odds of the mean probability it is about even.
        .withColumn("_bin", F.least(F.lit(BINS - 1), F.floor(F.col("_q") / (F.col("_q") + (1 - F.col("_q")) * (1 - p) / p) * BINS)).cast("int"))
    )
    # Words before each bin of a source: a histogram, so that no source's documents meet in one task.
    # Documents taken for certain have a bin of their own before the others, whose words don't count.
    ranked = ranked.withColumn("_bin", F.when(F.col("_weight") >= F.col("_sure"), -1).otherwise(F.col("_bin")))
    bins = ranked.groupBy("source", "_bin", "_rest").agg(F.sum(F.when(F.col("_bin") >= 0, F.col("size")).otherwise(0)).alias("_words"))
    upto = F.sum("_words").over(Window.partitionBy("source").orderBy("_bin"))
    # Words only grow from bin to bin, so of each source all bins up to one are in, and at most one is cut: a row per source.
    bins = bins.withColumn("_upto", upto).select("source", "_bin", (F.col("_upto") - F.col("_words")).alias("_before"), ((F.col("_bin") < 0) | (F.col("_upto") <= F.col("_rest"))).alias("_in"), "_rest")
    cut = ~F.col("_in") & (F.col("_before") < F.col("_rest"))
    bins = bins.groupBy("source").agg(
        F.coalesce(F.max(F.when(F.col("_in"), F.col("_bin"))), F.lit(-2)).alias("_last"), F.min(F.when(cut, F.col("_bin"))).alias("_cut"), F.min(F.when(cut, F.col("_before"))).alias("_before"),
    ).withColumnRenamed("source", "_source")
    binned = ranked.join(small(checkpoint(bins)), F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("_in", F.col("_bin") <= F.col("_last"))
    edge = F.coalesce(F.col("_bin") == F.col("_cut"), F.lit(False))
    sure = binned.where(~edge).withColumn("_more", F.col("_in"))
    ahead = F.sum("size").over(Window.partitionBy("source", "_bin").orderBy("_q", "_h", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    near = binned.where(edge).withColumn("_more", F.col("_before") + F.coalesce(ahead, F.lit(0)) + F.col("size") / 2 <= F.col("_rest"))
    out = sure.unionByName(near).withColumn("taken", (F.col("size") * (F.col("_whole") + F.col("_more").cast("long"))).cast("long"))
    return out.drop("_h", "_u", "_weight", "_total", "_sure", "_whole", "_rest", "_p", "_q", "_bin", "_before", "_last", "_cut", "_in", "_more")


def copies(mixed: DataFrame) -> DataFrame:
    """The mix itself: a row for each time that a document goes in, numbered by ``copy`` from 0."""
    name = free_name(mixed, "copy")
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(F.lit(0))
    return mixed.withColumn(name, F.explode(F.when(times > 0, F.sequence(F.lit(0), times - 1))))

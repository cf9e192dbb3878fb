"""What each filter removes in every order of applying a set of filters, and each filter's share over all orders.

Spark reduces documents to cells: for each part and each set of filters that fail, the number of documents, of good and
of toxic ones. With ``k`` filters a part has ``2 ** k`` cells at most, however many documents it has. All orders are then
walked by adjacent transpositions: the next order differs from the last by one swap of neighbours, so only the two
steps at the swap are counted again from the cells; what the others remove stays. Shapley sums (a filter's removed
documents, over all orders) are added up along the walk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakelineage.llm.common import stored

#: Parts walked at a time, a bound on memory: each gives k * k! rows.
PARTS = 128
RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_filters() -> dict[str, Column]:
    """Conditions on ``text`` (not null) under which a document fails. Words: runs of anything but space and \\x09-\\x0D."""
    text = F.col("text")
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals.cast("long") > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def swaps(k: int) -> Iterator[int]:
    """Places ``i`` at which to swap ``i`` and ``i + 1``, one after the other, to visit all orders of ``k`` once.

    The last element goes through the others to one end and back; at each end the others make their own next swap.
    """
    if k < 2:
        return
    inner, down = swaps(k - 1), True
    while True:
        yield from range(k - 2, -1, -1) if down else range(k - 1)
        at = next(inner, None)
        if at is None:
            return
        yield at + 1 if down else at
        down = not down


def walk(cells: np.ndarray, names: str) -> dict[str, np.ndarray]:
    """Counts of every order, step and part. ``cells``: counts of [all, good, toxic] x part x mask. Arrays: order x step x part."""
    k, mask = len(names), np.arange(1 << len(names))

    def step(name: int, before: int) -> np.ndarray:
        """[kept, removed, good, toxic] x part: of the documents that pass the filters in ``before``."""
        gone = ((mask & before) == 0) & (mask >> name & 1 == 1)
        kept = ((mask & (before | 1 << name)) == 0)
        return np.stack([cells[0][:, kept].sum(1), *(c[:, gone].sum(1) for c in cells)])

    order, before, steps = list(range(k)), 0, []
    for f in order:
        steps.append(step(f, before))
        before |= 1 << f
    orders, seen, shapley = [tuple(order)], [np.stack(steps)], np.stack([s[1] for s in steps])
    for i in swaps(k):
        order[i], order[i + 1] = order[i + 1], order[i]
        before = sum(1 << f for f in order[:i])
        steps[i], steps[i + 1] = step(order[i], before), step(order[i + 1], before | 1 << order[i])
        for f, s in zip(order, steps, strict=True):
            shapley[f] += s[1]
        orders.append(tuple(order))
        seen.append(np.stack(steps))
    at = np.array(orders)
    found = np.stack(seen)  # order x step x [kept, removed, good, toxic] x part
    fails = np.stack([cells[0][:, mask >> f & 1 == 1].sum(1) for f in range(k)])
    alone = np.stack([cells[0][:, 1 << f] for f in range(k)])
    kept, removed, good, toxic = (found[:, :, i] for i in range(4))
    return {"orders": at, "kept": kept, "removed": removed, "redundant": fails[at] - removed, "unique_fails": alone[at], "good_lost": good, "toxic_lost": toxic, "shapley": shapley[at]}


def cells(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], part: str = "source") -> DataFrame:
    """``part``, ``mask`` (bit ``i``: the ``i``-th filter fails; the bit after the last: the text is a repeat), ``n``, ``good``, ``toxic``.

    A text is read once and never shuffled: its SHA-256 stands for it. The first document of each text is found by a
    ``min`` (combined before the shuffle) and marked by a join on digest and id, so that a text of a third of all
    documents spreads over all tasks.
    """
    text = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    mask = sum((F.coalesce(c, F.lit(False)).cast("int") * (1 << i) for i, c in enumerate(filters.values())), F.lit(0))
    rows = stored(text.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    repeat = F.col("doc_id").isNotNull() & F.col("_first").isNull()
    known = rows.join(first, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
    known = known.select("part", (F.col("mask") + F.when(repeat, 1 << len(filters)).otherwise(0)).alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    return known.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, repeats: str = "E", part: str = "source") -> DataFrame:
    """A row per part, order of filters and step (from 1), zeros included.

    ``docs``: ``doc_id``, ``text``, the column ``part``, any more; ``labels``: ``doc_id``, ``quality``, ``toxic``. ``filters``:
    failure conditions by letter (:func:`text_filters`); ``repeats`` is the letter of the filter that fails texts equal
    to the text of any smaller id in the whole table.

    ``kept``: documents left after the step; ``removed``: by it; ``redundant``: failing its filter but removed earlier;
    ``unique_fails``: failing no other filter; ``good_lost`` and ``toxic_lost``: removed ones with quality 1 and toxic 1;
    ``shapley``: removed by its filter, summed over all orders.

    Defined cases: a null text is empty; a null part is the empty string's; a null condition passes; a null id is
    neither smaller than another nor has a smaller one, and has no labels; rows that repeat an id are documents of their
    own, and those with the smallest id of a text all pass; several labels of an id count as good or toxic if any is;
    an empty table has no parts and gives no rows.
    """
    filters = text_filters() if filters is None else filters
    names = "".join(filters) + repeats
    k = len(names)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), PARTS):
                rows = batch.iloc[at : at + PARTS]
                counts = np.zeros((3, len(rows), 1 << k), np.int64)
                for i, found in enumerate(rows["cells"]):
                    for c in found:
                        counts[:, i, c["mask"]] = c["n"], c["good"], c["toxic"]
                got = walk(counts, names)
                orders = ["".join(names[f] for f in o) for o in got.pop("orders")]
                shape = (len(orders), k, len(rows))
                made = {c: v.reshape(-1) for c, v in got.items()}
                made["part"] = np.broadcast_to(rows["part"].to_numpy(object), shape).reshape(-1)
                made["filter_order"] = np.broadcast_to(np.array(orders, object)[:, None, None], shape).reshape(-1)
                made["step"] = np.broadcast_to(np.arange(1, k + 1, dtype=np.int32)[:, None], shape).reshape(-1)
                yield pd.DataFrame(made)

    found = cells(docs, labels, filters, part).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return found.mapInPandas(task, RESULT).select(*[c.split()[0] for c in RESULT.split(", ")])

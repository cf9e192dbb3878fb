"""Names in requests to assets: exact, within a table, contained and close names, for many requests at once.

Requests are reduced to distinct questions (name, table, system, wanted types), assets to distinct normalised names. Tiers:

1. the same name, in the hinted table; 2. the same name, ids that hold the hint first; 3. one name within the other;
4. the five closest names by ``difflib`` ratio, of at least :data:`CUTOFF`.

The first tier with candidates decides. Among those: wanted system and type, wanted type, wanted system, any; then the
closest name; then the assets' order. Names without a letter or digit of their own (nothing left of them once
normalised) match nothing.

No question meets all names. Contained names are found by joins on substrings and on a question's rarest gram, close
ones by an inverted index of counted characters, in which names of the same length and the same characters out of those
that questions have are one entry, and only the rare part of each entry is listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakelineage.functions.lineage import beside, cut_counted

# Least ratio of a close name and the number of close names looked at.
CUTOFF = 0.6
NEAREST = 5
GRAM = 3


def norm(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, r"[\s_\-]+", ""))


def grams(x: Column, size: int) -> Column:
    """Distinct substrings of ``size`` characters; none of a shorter text."""
    starts = F.when(F.length(x) >= size, F.sequence(F.lit(1), F.length(x) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(x, i, F.lit(size))))


def holding(questions: DataFrame, texts: DataFrame) -> DataFrame:
    """``q`` and the columns of ``texts`` but ``text``, distinct: texts that hold a question (distinct, not empty).

    A text is looked up by the question's rarest gram, and not at all if a gram of the question is in no text.
    """
    sizes = [r[0] for r in questions.select(F.least(F.lit(GRAM), F.length("q"))).distinct().collect()]  # 1 to GRAM
    asked = questions.select("q", F.explode(F.coalesce(*[F.when(F.least(F.lit(GRAM), F.length("q")) == n, grams(F.col("q"), n)) for n in sizes or [1]])).alias("gram"))
    once, n_grams = cut_counted(asked.select("gram").distinct())
    keys = [c for c in texts.columns if c != "text"]
    listed = texts.select(*keys, "text", F.explode(F.flatten(F.array(*[grams(F.col("text"), n) for n in sizes or [1]]))).alias("gram"))
    often = listed.select("gram").join(beside(once, n_grams), "gram").groupBy("gram").agg(F.count("*").alias("_n"))
    rarest = asked.join(often, "gram", "left").groupBy("q").agg(F.min_by("gram", F.struct("_n", "gram")).alias("gram"), F.count_if(F.col("_n").isNull()).alias("_gone")).where("_gone = 0")
    rarest, n_asked = cut_counted(rarest.select("q", "gram"))
    return listed.join(beside(rarest, n_asked), "gram").where(F.contains("text", "q")).select("q", *keys).distinct()


def contained(questions: DataFrame, names: DataFrame) -> DataFrame:
    """``q``, ``name``: pairs of which one is a substring of the other. ``questions``: ``q``, ``names``: ``name``; distinct, not empty.

    A name within a question equals one of its substrings (of a length that some name has); for the others see :func:`holding`.
    """
    lengths = names.select(F.length("name").alias("_l")).distinct()
    parts = questions.select("q", F.explode(F.sequence(F.lit(1), F.length("q"))).alias("_l")).join(lengths, "_l")
    parts = parts.select("q", F.explode(F.sequence(F.lit(1), F.length("q") - F.col("_l") + 1)).alias("_i"), "_l")
    within = parts.select("q", F.substring(F.col("q"), F.col("_i"), F.col("_l")).alias("name")).distinct().join(names.hint("merge"), "name").select("q", "name")

    return within.unionByName(holding(questions, names.select("name", F.col("name").alias("text"))).select("q", "name")).distinct()


def counted(x: Column) -> Column:
    """Characters with the number of their occurrence (the third ``a`` is ``003a``), a set as large as the text is long.

    Later occurrences and characters of high code points come first: they are the rarer ones in names. Any order gives
    the same results, but the first ones are what names are looked up by.
    """
    upto = lambda i: F.substring(x, F.lit(1), i)
    own = lambda i: F.substring(x, i, F.lit(1))
    nth = lambda i: F.length(upto(i)) - F.length(F.replace(upto(i), own(i), F.lit("")))
    return F.sort_array(F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.lpad(nth(i).cast("string"), 6, "0"), own(i))), asc=False)


def _listed(df: DataFrame, chars: Column, n: Column, place: str, size: str) -> DataFrame:
    """``df`` with ``token`` of the first part of the counted characters of ``chars``, with its ``place``, and ``size``: ``n``, the text's length.

    A close partner has at least 3/7 of the length, and both together hold 3/10 of their lengths in common characters at
    least; texts that have so many in common share one of their first ``size - common + 1``.
    """
    common = F.ceil((n + F.ceil(n * 3 / 7)) * 3 / 10)
    first = F.slice(counted(chars), F.lit(1), (F.length(chars) - common + 1).cast("int"))
    return df.where(F.length(chars) >= common).select("*", n.alias(size), F.posexplode(first).alias(place, "token"))


def close(questions: DataFrame, names: DataFrame, kept: int = NEAREST) -> DataFrame:
    """``q``, ``name``, ``place`` (from 1): the ``kept`` closest names of each question, of :data:`CUTOFF` or more.

    The ratio is twice the matched characters over both lengths; no more characters match than both have in common, which
    bounds lengths, places in the index and the number of common characters before a ratio is computed. Names are looked up
    by their length and those of their characters that any question has, sorted (``shape``): all that these bounds depend
    on. A question's names come with the greatest bound first, and none is compared that can't be among the kept ones.
    """
    chars = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.substring(x, i, F.lit(1)))
    known = [r[0] for r in questions.select(F.explode(chars(F.col("q")))).distinct().collect()]  # the characters of a script or two
    others = f"[^{''.join(f'{chr(92)}x{{{ord(c):x}}}' for c in known)}]" if known else "(?s)."
    shaped = names.select("name", F.array_join(F.sort_array(chars(F.regexp_replace("name", others, ""))), "").alias("shape"), F.length("name").alias("_n")).where("shape <> ''")
    shapes, n_shapes = cut_counted(shaped.select("shape", "_n").distinct())
    asked = _listed(questions.select("q"), F.col("q"), F.length("q"), "_i", "_m")
    both = asked.join(beside(_listed(shapes.withColumnRenamed("_n", "_l"), F.col("shape"), F.col("_l"), "_j", "_n").drop("_l"), 10 * n_shapes), "token")
    total, ahead = F.col("_m") + F.col("_n"), F.least(F.col("_m") - F.col("_i"), F.length("shape") - F.col("_j"))  # places count from 0
    pairs = both.where((10 * F.least("_m", "_n") >= 3 * total) & (10 * ahead >= 3 * total)).select("q", "shape", "_m", "_n").distinct()
    pairs = pairs.withColumn("_common", F.size(F.array_intersect(counted(F.col("q")), counted(F.col("shape"))))).where(10 * F.col("_common") >= 3 * total)
    pairs, n_pairs = cut_counted(pairs.select("q", "shape", "_n", (2 * F.col("_common") / total).alias("_most")))

    def ratios(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        match, q, best = SequenceMatcher(None), None, []
        for b in batches:
            found = []
            for asked_, name, most in zip(b["q"], b["name"], b["_most"], strict=True):
                if asked_ != q:
                    q, best = asked_, []
                    match.set_seq2(q)
                if len(best) == kept and most < best[0]:
                    continue
                match.set_seq1(name)
                ratio = match.ratio()
                if ratio >= CUTOFF:
                    found.append((q, name, ratio))
                    (heapq.heappush if len(best) < kept else heapq.heappushpop)(best, ratio)
            yield pd.DataFrame(found, columns=["q", "name", "ratio"])

    near = shaped.join(beside(pairs, n_pairs), ["shape", "_n"]).select("q", "name", "_most").repartition("q").sortWithinPartitions("q", F.desc("_most")).mapInPandas(ratios, "q string, name string, ratio double")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("ratio"), F.desc("name")))  # Spark keeps the first ones of each task before the shuffle
    return near.withColumn("place", nth).where(F.col("place") <= kept).select("q", "name", "place")


def _first(rows: DataFrame, *by: str) -> DataFrame:
    """The first asset of each kind, which is all that can win: a row per ``by``, type and system."""
    return rows.groupBy(*by, "asset_type", "asset_system").agg(F.min(F.struct("place", "seq", "id")).alias("_at"))


def resolve(requests: DataFrame, assets: DataFrame) -> DataFrame:
    """``requests`` (``target_name``, ``table_name``, ``system``, ``change_type``, any more) with ``asset_id``, ``asset_type`` and ``tier``; null if there is none."""
    types = F.when(F.col("change_type").startswith("TABLE"), "table").when(F.col("change_type").startswith("COLUMN"), "column")
    own = requests.withColumns({"_q": norm(F.col("target_name")), "_hint": norm(F.coalesce("table_name", F.lit(""))), "_want": types})
    keys = ["_q", "_hint", "_want", "system"]
    questions, n_asked = cut_counted(own.where("_q <> ''").select(*keys).distinct())
    parts = F.split("id", "::")
    tables = [F.when(F.size(parts) > 2, F.element_at(parts, -2))] + ([F.try_element_at("properties", F.lit("table_name"))] if "properties" in assets.columns else [])
    rows = assets.select("id", "asset_type", F.col("system").alias("asset_system"), "seq", norm(F.col("name")).alias("name"), F.array_distinct(F.array_compact(F.transform(F.array(*tables), norm))).alias("_tables"), F.lit(0).alias("place")).where("name <> ''")

    hints = beside(questions.where("_hint <> ''").select("_q", "_hint").distinct(), n_asked)
    in_table = _first(rows.withColumn("_table", F.explode("_tables")).join(hints, (F.col("name") == F.col("_q")) & (F.col("_table") == F.col("_hint"))), "_q", "_hint").withColumn("tier", F.lit(1))
    hinted = _first(rows.join(hints, F.col("name") == F.col("_q")).where(F.contains(norm(F.col("id")), F.col("_hint"))), "_q", "_hint").withColumn("tier", F.lit(2))
    heads = _first(rows, "name")  # whatever a name was found by
    same = heads.join(beside(questions.select("_q").distinct(), n_asked), F.col("name") == F.col("_q")).drop("name")
    found = [in_table.withColumn("_order", F.lit(1)), hinted.withColumn("_order", F.lit(2))]
    anywhere = [same.withColumns({"tier": F.lit(2), "_order": F.lit(3)})]

    rest, left = cut_counted(questions.select("_q").distinct().join(same.select("_q").hint("merge"), "_q", "left_anti").withColumnRenamed("_q", "q"))
    if left:
        names, _ = cut_counted(rows.select("name").distinct())
        parts_, n_parts = cut_counted(contained(rest, names))
        near, n_near = cut_counted(close(rest.join(parts_.select("q").hint("merge"), "q", "left_anti"), names))
        for pairs, n, tier in ((parts_.withColumn("_near", F.lit(0)), n_parts, 3), (near.withColumnRenamed("place", "_near"), n_near, 4)):
            held = heads.join(beside(pairs, n), "name").select(F.col("q").alias("_q"), "asset_type", "asset_system", F.col("_near").alias("place"), F.col("_at.seq").alias("seq"), F.col("_at.id").alias("id"))
            anywhere.append(_first(held, "_q").withColumns({"tier": F.lit(tier), "_order": F.lit(tier + 1)}))
    asked = questions.withColumns({c: F.col(c) for c in keys})
    with_hint = found[0].unionByName(found[1])
    without = anywhere[0]
    for more in anywhere[1:]:
        without = without.unionByName(more)
    asked = beside(asked, n_asked)
    candidates = with_hint.join(asked, ["_q", "_hint"]).unionByName(without.join(asked, "_q"))
    typed = F.when(F.col("_want") == "table", F.col("asset_type").isin("table", "database_table")).when(F.col("_want") == "column", F.col("asset_type").isin("column", "database_column"))
    of_system = F.col("asset_system") == F.col("system")
    prefer = F.when(of_system & typed, 0).when(typed, 1).when(of_system, 2).otherwise(3)
    best = candidates.groupBy(*keys).agg(F.min(F.struct("_order", prefer.alias("prefer"), "_at", "asset_type", "tier")).alias("_best"))
    best = best.select(*[F.col(c).alias(f"_{c}_") for c in keys], F.col("_best._at.id").alias("asset_id"), "_best.asset_type", "_best.tier")
    on = F.lit(True)
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}_"))
    return own.join(beside(best, n_asked), on, "left").drop("_q", "_hint", "_want", *[f"_{c}_" for c in keys])

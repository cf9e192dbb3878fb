r"""Personal data by bootstrapped contextual extraction; DataFrame functions only.

Regular forms (e-mail, IP, card and phone numbers) are the seeds; so are long tokens of letters and digits, as secrets.
The two words before a seed, the word before it and the word after it are lexical patterns, from rare to general; so is
what stands around any other token that holds a digit or ``@``. Patterns and the instances (tokens) that they introduce
form a bipartite graph, which is scored in rounds: a pattern is as sure of a kind as the mean of its instances; a seed is
wholly sure, another instance as the sure patterns that introduce it together, leaving out the pattern that is scored.
Rounds go on until no further pattern becomes sure, so what one pattern discovers makes others sure, seeds or not. Sure
patterns with enough support add the unseen tokens that they introduce, and secrets, which count as personal data only where a sure pattern
introduces them. Where patterns disagree, the surest one says what a token is. Of the words around a token, those within
CONTEXT code points are read; a pattern needs SUPPORT distinct instances.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakelineage.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
SECRET = len(KINDS)  # the kind of spans that only context adds
NAMES = (*KINDS, "secret")
#: The given forms. Where a match can't begin in the middle of a run, that is said, so that no run is read twice; groups
#: are possessive, which changes no match (what follows a group can't be in it) and needs no stack.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character without which there is no match.
HINTS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
CONTEXT = 60  # code points before a token in which its pattern's words are read; of a longer word its end counts
SUPPORT = 5  # distinct instances that a pattern has at least
SURE = 0.8  # mean score of a pattern that adds spans
SPAN = "array<struct<kind:int,start:bigint,end:bigint>>"
TOKENS = "array<struct<match:string,start:bigint,end:bigint,before:string,after:string>>"
FOUND = "array<struct<kind:int,start:bigint,end:bigint,match:string>>"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    doubled = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def holds(kind: str, match: Column) -> Column:
    """Whether a match of the form is one of the kind."""
    n = F.length(digits(match))
    if kind == "ip":
        bare = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(match, r"\."), lambda p: (F.length(bare(p)) <= 2) | (F.length(bare(p)) == 3) & (bare(p) <= "255"))
    if kind == "card":
        return F.when(n.between(16, 19), luhn(digits(match))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def located(text: Column, form: str) -> Column:
    """Array of (match, start, end, before, after) of all matches of ``form``: what stands between them tells where they are."""
    between = F.split(text, form, -1)
    matches = F.regexp_extract_all(text, F.lit(form), F.lit(0))
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(TOKENS).alias("found"))

    def add(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["b"])
        end = start + F.length(x["m"])
        span = F.struct(x["m"].alias("match"), start.alias("start"), end.alias("end"), F.substring(x["b"], -CONTEXT, CONTEXT).alias("before"), F.substring(x["a"], 1, CONTEXT).alias("after"))
        return F.struct(end.alias("at"), F.concat(s["found"], F.array(span)).alias("found"))

    pairs = F.arrays_zip(F.slice(between, 1, F.size(matches)).alias("b"), matches.alias("m"), F.slice(between, 2, F.size(matches)).alias("a"))
    return F.aggregate(pairs, empty, add, lambda s: s["found"])


def base_spans(text: Column) -> Column:
    """All base spans of a text with what they cover, by kind, then start."""

    def of(i: int, kind: str) -> Column:
        hint = F.contains(text, F.lit("@")) if kind == "email" else F.contains(text, F.lit(HINTS[kind])) & text.rlike("[0-9]")
        good = F.filter(located(text, FORMS[kind]), lambda m: holds(kind, m["match"]))
        return F.when(hint, F.transform(good, lambda m: F.struct(F.lit(i).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["match"].alias("match")))).otherwise(F.array().cast(FOUND))

    return F.flatten(F.array(*[of(i, kind) for i, kind in enumerate(KINDS)]))


def written(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, NAMES)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret(token: Column) -> Column:
    """Whether a token is a long run of letters and digits, several of each."""
    count = lambda kind: F.length(F.regexp_replace(token, f"[^{kind}]", ""))
    return token.rlike("^[A-Za-z0-9_-]{16,}$") & (count("0-9") >= 4) & (count("A-Za-z") >= 4)


def candidates(rows: DataFrame) -> DataFrame:
    """Tokens with a digit or ``@``, a row per pattern: ``key``, ``start``, ``end``, ``instance``, ``pattern``, ``kind`` of the seed there, if any, ``is_base``.

    ``rows``: ``key``, ``base``, ``tokens``. A token's edges lose punctuation. A base span of several tokens counts once,
    by the first; a token that touches spans of several kinds counts for the first kind. Patterns are in lower case and
    begin with ``2`` (two words before), ``1`` (one) or ``+`` (the word after).
    """
    some = rows.select("key", "base", F.explode("tokens").alias("t"))
    lead = F.length(F.regexp_extract("t.match", r"^[^A-Za-z0-9@+_]*", 0))
    core = F.regexp_extract("t.match", r"^[^A-Za-z0-9@+_]*(.*?)[^A-Za-z0-9]*$", 1)
    some = some.select("key", "base", F.lower("t.before").alias("before"), F.lower("t.after").alias("after"), (F.col("t.start") + lead).alias("start"), core.alias("token"))
    some = some.where(F.length("token") > 0).withColumn("end", F.col("start") + F.length("token"))
    inside = F.filter("base", lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start")))
    some = some.withColumn("span", F.try_element_at(inside, F.lit(1)))
    some = some.where(F.col("span").isNull() | (F.col("span.start") >= F.col("start") - 1))
    one = F.regexp_extract("before", r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1)
    two = F.regexp_replace(F.regexp_extract("before", r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]+[^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1), r"[\x20\x09-\x0D]+", " ")
    next_ = F.regexp_extract("after", r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+)", 1)
    shapes = F.array(*[F.when(words != "", F.concat(F.lit(mark), words)) for mark, words in (("2", two), ("1", one), ("+", next_))])
    kind = F.coalesce(F.col("span.kind"), F.when(secret(F.col("token")), SECRET))
    some = some.select("key", "start", "end", F.lower(F.coalesce("span.match", "token")).alias("instance"), kind.alias("kind"), F.col("span").isNotNull().alias("is_base"), F.explode(F.array_compact(shapes)).alias("pattern"))
    return some


def sure_patterns(found: DataFrame) -> DataFrame:
    """``pattern``, ``kind`` and ``score`` of patterns that add spans.

    Edges are distinct (pattern, instance) pairs, combined before they are shuffled. Scores only grow from round to
    round, so the rounds end; each is cut by a table.
    """
    edges = found.groupBy("pattern", "instance").agg(F.min("kind").alias("kind"))
    size = stored(edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT))
    edges = stored(edges.join(size, "pattern"))
    seeds = stored(edges.where("kind IS NOT NULL").select("instance", F.col("kind").alias("k")).distinct())
    own = edges.join(seeds, "instance").groupBy("pattern", "k", "n").agg((F.count("*") / F.col("n")).alias("seeded"))
    own = stored(own)
    surely = lambda rows: stored(rows.where(F.col("score") >= SURE).select("pattern", "k", "score", F.log(F.greatest(F.lit(1e-9), 1 - F.col("score"))).alias("doubt")))
    sure = surely(own.withColumn("score", F.col("seeded")))
    n = sure.count()
    while n:
        said = edges.join(sure, "pattern").groupBy("instance", "k").agg(F.sum("doubt").alias("together"))
        said = edges.select("pattern", "instance", "n").join(said.join(seeds, ["instance", "k"], "left_anti"), "instance")
        said = said.join(sure.select("pattern", "k", "doubt"), ["pattern", "k"], "left")
        gained = said.groupBy("pattern", "k", "n").agg((F.sum(1 - F.exp(F.col("together") - F.coalesce("doubt", F.lit(0.0)))) / F.col("n")).alias("gained"))
        both = own.join(gained, ["pattern", "k", "n"], "full")
        more = surely(both.withColumn("score", F.coalesce("seeded", F.lit(0.0)) + F.coalesce("gained", F.lit(0.0))))
        before, n, sure = n, more.count(), more
        if n == before:
            break
    return sure.select("pattern", F.col("k").alias("kind"), "score")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``base`` and ``added``: spans (kind by its place in NAMES, start, end in code points) of each row.

    Defined cases: null and empty texts have no spans; rows equal in id and text have equal results; offsets are of
    whole texts of any length; an empty table gives an empty result; other columns are not used. Added spans never
    touch base spans.
    """
    text = F.coalesce("text", F.lit(""))
    tokens = F.when(text.rlike("[0-9@]"), located(text, TOKEN)).otherwise(F.array().cast(TOKENS))
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), base_spans(text).alias("base"), tokens.alias("tokens"))
    rows = stored(rows)  # texts are read once
    found = candidates(rows)
    sure = sure_patterns(found.select("pattern", "instance", "kind"))
    fresh = found.where(~F.col("is_base")).drop("kind").join(sure, "pattern")
    fresh = fresh.groupBy("key", "start", "end").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
    spans = fresh.select("key", F.struct(F.col("kind").cast("int").alias("kind"), "start", "end").alias("s")).groupBy("key").agg(F.array_sort(F.collect_set("s")).alias("added"))
    plain = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    done = rows.select("doc_id", "key", plain.alias("base")).join(spans, "key", "left")
    return done.select("doc_id", "base", F.coalesce("added", F.array().cast(SPAN)).alias("added"))


def digest(found: DataFrame) -> DataFrame:
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")
    both = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", *map(count, range(len(KINDS))), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(both).alias("spans"), F.size("added").cast("long").alias("n_added"), F.size(both).cast("long").alias("n_spans"))

"""Text functions of change analysis: keywords and relevance, responses of a language model, scrubbing."""

from __future__ import annotations

from collections.abc import Iterator
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that are no keywords, what stands between tokens, and how many artifacts of each kind are kept.
STOPWORDS = (
    "a", "an", "the", "to", "in", "of", "for", "and", "or", "is",
    "are", "be", "been", "this", "that", "with", "add", "new", "change",
    "update", "remove", "rename", "modify", "create", "delete", "want",
    "need", "should", "would", "will", "on", "at", "by", "from",
)
BETWEEN = r"[\s,.\-/\\()\[\]\"']+"
KEPT = {"table": 5, "measure": 8, "column": 10, "report": 4, "relationship": 5}


def keywords(text: Column) -> Column:
    """Distinct lower-case tokens of three characters or more that aren't stop words."""
    words = F.filter(F.split(F.lower(text), BETWEEN), lambda w: (F.length(w) >= 3) & ~w.isin(*STOPWORDS))
    return F.array_distinct(words)


def relevance(name: Column, keys: Column) -> Column:
    """How many of the keywords a name (with what else describes the artifact) contains."""
    return F.size(F.filter(keys, lambda k: F.contains(F.lower(name), k)))


def with_table_point(artifacts: DataFrame, tables: DataFrame) -> DataFrame:
    """Columns (``kind``, ``table``, ``score``) of the tables that are kept (``name``) get a point more."""
    kept = tables.select(F.col("name").alias("_kept")).distinct()
    return artifacts.join(kept, (F.col("kind") == "column") & (F.col("table") == F.col("_kept")), "left").withColumn("score", F.col("score") + F.col("_kept").isNotNull().cast("int")).drop("_kept")


def most_relevant(artifacts: DataFrame, kept: dict[str, int] | None = None) -> DataFrame:
    """Of each kind the most relevant artifacts (``kind``, ``name``, ``score``), by name where scores are equal.

    Those without a score count only where none of the kind has one.
    """
    kept = KEPT if kept is None else kept
    limit = F.create_map(*[F.lit(x) for kv in kept.items() for x in kv])
    best = F.max("score").over(Window.partitionBy("kind"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("score"), "name"))
    ranked = artifacts.withColumns({"_best": best, "place": place})
    return ranked.where((F.col("place") <= F.try_element_at(limit, F.col("kind"))) & ((F.col("score") > 0) | (F.col("_best") == 0))).drop("_best")


# Words by which a text speaks of the assets of a bucket.
BUCKET_WORDS = {
    "database_tables": ("database table", "sql table", "db table"),
    "views": ("view", "sql view", "db view"),
    "materialized_views": ("materialized view", "materialised view"),
    "stored_procedures": ("stored procedure", "stored proc", "sproc"),
    "functions": ("udf", "user-defined function", "sql function"),
    "databricks_notebooks": ("databricks notebook", "notebook", "databricks"),
    "spark_jobs": ("spark job", "spark cluster", "spark submit"),
    "delta_live_tables": ("delta live", "dlt pipeline", "delta live table"),
    "unity_catalog": ("unity catalog", "unity catalogue"),
    "pipelines": ("pipeline", "etl pipeline", "data pipeline"),
    "data_factory": ("data factory", "adf", "azure data factory"),
    "airflow": ("airflow", "dag ", "airflow dag"),
    "fabric_pipelines": ("fabric pipeline", "microsoft fabric"),
    "semantic_models": ("semantic model", "dataset", "tabular model"),
    "powerbi_reports": ("power bi report", "powerbi report", "pbi report", "report page"),
    "dashboards": ("dashboard",),
    "apis": (" api ", "rest api", "web api", "api endpoint"),
    "external_consumers": ("external consumer", "downstream consumer"),
}


def words_of_buckets(buckets: Column) -> Column:
    """Words of all buckets in an array of their names; buckets without words add none."""
    words = F.create_map(*[x for b, ws in BUCKET_WORDS.items() for x in (F.lit(b), F.array(*map(F.lit, ws)))])
    return F.flatten(F.transform(buckets, lambda b: F.coalesce(F.try_element_at(words, b), F.array().cast("array<string>"))))


def scrubbed(rows: DataFrame, lists: tuple[str, ...] = ("deployment_plan", "validation_checklist", "rollback_plan")) -> DataFrame:
    """``rows`` whose ``lists`` lose items that speak of a bucket in ``empty_buckets``, and ``removed``: those items, in order."""
    rows = rows.withColumn("_words", words_of_buckets(F.coalesce("empty_buckets", F.array().cast("array<string>"))))
    kept = {c: scrub(F.coalesce(c, F.array().cast("array<string>")), F.col("_words")) for c in lists}
    gone = F.concat(*[F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda i: F.exists("_words", lambda w: F.contains(F.lower(i), F.lower(w)))) for c in lists])
    return rows.withColumn("removed", gone).withColumns(kept).drop("_words")


def scrub(items: Column, empty_words: Column) -> Column:
    """Items of a list that mention none of the words (of empty buckets), in any case."""
    return F.filter(items, lambda i: ~F.exists(empty_words, lambda w: F.contains(F.lower(i), F.lower(w))))


LISTS = ("deployment_plan", "validation_checklist", "rollback_plan")
TRAILING_COMMA = re.compile(r",(?=\s*[}\]])")


def json_of(text: str | None) -> str | None:
    """The JSON object in a model's response: the first of a code fence, else of the text; trailing commas are left out."""
    text = text or ""
    fenced = re.search(r"```\w*\s*(?=\{)", text)
    for start in [m for m in (fenced.end() if fenced else -1, text.find("{")) if m >= 0]:
        for candidate in (text[start:], TRAILING_COMMA.sub("", text[start:])):
            try:
                return json.dumps(json.JSONDecoder().raw_decode(candidate)[0], ensure_ascii=False)
            except ValueError:
                continue
    return None


def with_lists(found: str | None) -> str | None:
    """A JSON object whose plans are lists: a text becomes a list of it, unless it is blank; what else isn't a list goes."""
    fields = json.loads(found) if found else None
    if not isinstance(fields, dict):
        return found
    for c in LISTS:
        x = fields.get(c)
        fields[c] = x if isinstance(x, list) else [x] if isinstance(x, str) and x.strip() else []
    return json.dumps(fields, ensure_ascii=False)


# What stands for a response that can't be read, and for fields that one lacks.
UNREADABLE = {"executive_summary": "[PARSE ERROR] Could not parse LLM response.", "risk_level": "critical", "risk_rationale": "Response parsing failed — manual review required."}
LACKING = {"executive_summary": "[PARSE ERROR] Could not parse LLM response.", "risk_level": "unknown", "risk_rationale": ""}
RESPONSE = "executive_summary string, risk_level string, risk_rationale string, deployment_plan array<string>, validation_checklist array<string>, rollback_plan array<string>"


def responses(rows: DataFrame) -> DataFrame:
    """``rows`` (``response``) with the fields of the response, with defaults where they are missing or not JSON."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, _json string"

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(_json=[with_lists(json_of(t)) for t in b["response"]])

    parsed = rows.mapInPandas(take, schema).withColumn("_r", F.from_json("_json", RESPONSE))
    lists = {c: F.coalesce(f"_r.{c}", F.array().cast("array<string>")) for c in LISTS}
    given = {"executive_summary": F.col("_r.executive_summary"), "risk_level": F.lower("_r.risk_level"), "risk_rationale": F.col("_r.risk_rationale")}
    plain = {c: F.when(F.col("_json").isNull(), UNREADABLE[c]).otherwise(F.coalesce(x, F.lit(LACKING[c]))) for c, x in given.items()}
    return parsed.withColumns(plain | lists).drop("_r", "_json")


def tokens_of(prompt: Column) -> Column:
    """Estimated tokens of a prompt: 1.3 a word."""
    return F.floor(F.size(F.filter(F.split(prompt, r"\s+"), lambda w: w != "")) * 1.3).cast("int")

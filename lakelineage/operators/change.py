"""Change requests: free text to a typed request, to an asset, to its impact, plans and texts; for many requests at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakelineage import schemas
from lakelineage.operators import graph
from lakelineage.operators.resolver import norm, resolve  # noqa: F401  part of this module's functions

# Forms of requests in the order in which they are tried. Groups: target, then table or new name.
RENAME_QUALIFIED = r"(?i)\brename\s+(?:the\s+)?(\w+)\s+(?:column\s+|table\s+)?(?:in|from|within|of)\s+(\w+)\s+(?:column\s+|table\s+)?to\s+(\w[\w\s]*?)(?:\s+(?:in|from|within|of)\s+\w+)?\s*$"
RENAME = r"(?i)\brename\s+(?:the\s+)?(\w+)\s+(?:column\s+|table\s+)?to\s+(\w[\w\s]*?)(?:\s+(?:in|from|within|of)\s+\w+)?\s*$"
RENAME_BARE = r"(?i)\brename\s+(\w+)\s+to\s+(\w[\w\s]*?)(?:\s+(?:in|from|within|of)\s+\w+)?\s*$"
COLUMN_DELETE = r"(?i)\b(?:drop|remove|delete)\s+(?:the\s+)?(\w+)\s+column\b"
COLUMN_ADD = r"(?i)\b(?:add|create|introduce)\s+(?:a\s+|an\s+|the\s+)?(?:new\s+)?(\w+)\s+column\b"
TABLE_DELETE = r"(?i)\b(?:drop|remove|delete)\s+(?:the\s+)?(?:table\s+)?([\w.\-/]+)\s*(?:table\b|$)"
TABLE_ADD = r"(?i)\b(?:add|create)\s+(?:the\s+|a\s+)?(?:table\s+)?([\w.\-/]+)\s*(?:table\b|$)"
KEYWORD_FORMS = (
    ("VIEW_CHANGE", r"(?i)\b(?:change|update|modify|alter)\b.+\bview\b"),
    ("PROCEDURE_CHANGE", r"(?i)\b(?:change|update|modify|alter)\b.+\b(?:procedure|proc|stored.procedure)\b"),
    ("NOTEBOOK_CHANGE", r"(?i)\b(?:change|update|modify|alter)\b.+\bnotebook\b"),
    ("PIPELINE_CHANGE", r"(?i)\b(?:change|update|modify|alter)\b.+\bpipeline\b"),
)
SYSTEM_HINTS = (
    ("databricks", r"(?i)\bdatabricks\b"), ("sql", r"(?i)\bsql\s+server\b|\bsql\b"), ("powerbi", r"(?i)\bpower\s*bi\b|\bpbi\b"), ("pipeline", r"(?i)\bpipeline\b"), ("database", r"(?i)\bdatabase\b|\bdb\b"), ("api", r"(?i)\bapi\b"),
)
STOPWORDS = ("the", "a", "an", "column", "table", "field", "attribute", "in", "from", "within", "of")
TABLE_HINT = r"(?i)\b(?:in|from|within|of)\s+(?:the\s+)?(\w+)"


def clean(x: Column) -> Column:
    """Without stop words; as it is if nothing else is left."""
    kept = F.array_join(F.filter(F.split(F.trim(x), r"\s+"), lambda w: ~F.lower(w).isin(*STOPWORDS)), " ")
    return F.when(kept == "", x).otherwise(kept)


def parse(requests: DataFrame) -> DataFrame:
    """``requests`` (``request_id``, ``request``) with ``change_type``, ``target_name``, ``new_name``, ``table_name`` and ``system``."""
    r = F.col("request")
    get = lambda p, i: F.regexp_extract(r, p, i)
    renamed = F.when(r.rlike(r"(?i)\btable\b"), "TABLE_RENAME").otherwise("COLUMN_RENAME")
    forms = [
        (RENAME_QUALIFIED, renamed, get(RENAME_QUALIFIED, 1), get(RENAME_QUALIFIED, 3), get(RENAME_QUALIFIED, 2)), (RENAME, renamed, get(RENAME, 1), get(RENAME, 2), None), (RENAME_BARE, renamed, get(RENAME_BARE, 1), get(RENAME_BARE, 2), None),
        (COLUMN_DELETE, F.lit("COLUMN_DELETE"), get(COLUMN_DELETE, 1), None, None), (COLUMN_ADD, F.lit("COLUMN_ADD"), get(COLUMN_ADD, 1), None, None), (TABLE_DELETE, F.lit("TABLE_DELETE"), get(TABLE_DELETE, 1), None, None),
        (TABLE_ADD, F.lit("TABLE_ADD"), get(TABLE_ADD, 1), None, None), *[(p, F.lit(k), None, None, None) for k, p in KEYWORD_FORMS],
    ]
    kind, target, new, table = F.lit("UNKNOWN"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern, k, t, n, own in reversed(forms):
        here = r.rlike(pattern)
        none = F.lit(None).cast("string")
        kind, target, new, table = F.when(here, k).otherwise(kind), F.when(here, none if t is None else clean(t)).otherwise(target), F.when(here, none if n is None else F.trim(n)).otherwise(new), F.when(here, none if own is None else own).otherwise(table)
    hints = F.filter(F.regexp_extract_all(r, F.lit(TABLE_HINT), F.lit(1)), lambda w: ~F.lower(w).isin(*STOPWORDS))
    system = F.lit(None).cast("string")
    for name, pattern in reversed(SYSTEM_HINTS):
        system = F.when(r.rlike(pattern), name).otherwise(system)
    return requests.withColumns({"change_type": kind, "target_name": target, "new_name": new, "table_name": F.coalesce(table, F.try_element_at(hints, F.lit(1))), "system": system})


def corrected(resolved: DataFrame) -> DataFrame:
    """``change_type`` made to fit the asset: deletions and renames of tables and columns."""
    kind = F.upper("asset_type")
    action = F.regexp_extract("change_type", "^(?:TABLE|COLUMN)_(DELETE|RENAME)$", 1)
    return resolved.withColumn("change_type", F.when((action != "") & F.col("asset_type").isin("table", "column"), F.concat(kind, F.lit("_"), action)).otherwise(F.col("change_type")))


def impact(resolved: DataFrame, assets: DataFrame, edges: DataFrame) -> DataFrame:
    """``request_id``, ``id``, ``name``, ``asset_type``, ``system``, ``direction``, ``depth``, ``bucket`` of all that each request touches."""
    asked = resolved.where("asset_id IS NOT NULL")
    found = graph.known_only(graph.bidirectional(edges, asked.select(F.col("asset_id").alias("id"))), assets)
    rows = asked.select("request_id", F.col("asset_id").alias("root")).join(found, "root").drop("root")
    return rows.withColumn("bucket", schemas.bucket(F.col("asset_type"), schemas.IMPACT_BUCKETS))


def bucket_counts(touched: DataFrame) -> DataFrame:
    """One row per request with a column per bucket."""
    return touched.groupBy("request_id").agg(F.count("*").alias("impacted"), F.sort_array(F.collect_set("system")).alias("systems"), *[F.count_if(F.col("bucket") == b).alias(b) for b in schemas.IMPACT_BUCKETS])


# What the plans say where a bucket has assets. Buckets of one row share their steps, in the order of deployment.
STEPS = (
    (("sql_views", "sql_procedures", "sql_functions"), "Update all affected SQL views, procedures, and functions.", "Restore previous SQL view/procedure/function definitions."),
    (("databricks_notebooks",), "Update Databricks notebooks: {names}.", "Revert Databricks notebooks to previous version."),
    (("databricks_pipelines",), "Re-run or reconfigure affected Databricks pipelines.", "Revert Databricks pipeline configurations."),
    (("workflow_tasks",), "Review and update workflow task configurations.", "Restore previous workflow task configurations."),
    (("adls_files",), "Refresh affected ADLS file ingestion mappings.", "Restore previous ADLS ingestion mappings."),
    (("semantic_models",), "Refresh Power BI semantic models and measures.", "Revert Power BI semantic model changes."),
    (("powerbi_reports",), "Republish and validate Power BI reports.", "Revert Power BI reports to last published version."),
)
CHECKS = (
    ("sql_views", "Confirm all SQL views return correct results."),
    ("sql_procedures", "Execute and validate all affected stored procedures."),
    ("sql_functions", "Test all affected SQL functions with representative inputs."),
    ("databricks_notebooks", "Re-run Databricks notebooks and check output tables."),
    ("databricks_pipelines", "Trigger a full pipeline run and verify data quality."),
    ("workflow_tasks", "Confirm all workflow tasks complete without errors."),
    ("adls_files", "Validate ADLS file ingestion completes successfully."),
    ("semantic_models", "Refresh Power BI semantic models and verify measure values."),
    ("powerbi_reports", "Open Power BI reports and confirm visuals render correctly."),
)
SYSTEM_LABELS = {"database": "Database", "sql": "SQL", "databricks": "Databricks", "pipeline": "Pipeline", "powerbi": "Power BI", "api": "API"}
NOTEBOOKS_NAMED = 3


def summaries(resolved: DataFrame, touched: DataFrame, assets: DataFrame) -> DataFrame:
    """``request_id``, ``executive_summary``, ``deployment_plan``, ``validation_checklist``, ``rollback_plan`` and ``summary`` (of several lines).

    Steps of buckets without assets are left out; deployment and rollback are numbered, and the rollback goes back
    through the deployment's steps. The first notebooks by name are named.
    """
    nth = F.row_number().over(Window.partitionBy("request_id").orderBy("name", "id"))
    first = touched.where("bucket = 'databricks_notebooks'").withColumn("_nth", nth).where(F.col("_nth") <= NOTEBOOKS_NAMED)
    first = first.groupBy("request_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_nth", "name"))), lambda x: x["name"]), ", ").alias("_names"))
    systems = touched.groupBy("request_id", "system").agg(F.count("*").alias("_n"))
    place = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(schemas.SYSTEMS) for x in (k, i)]), F.col("system"))
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SYSTEM_LABELS.items() for x in kv]), F.col("system")), F.col("system"))
    counted_ = F.concat(F.col("_n").cast("string"), F.lit(" "), label, F.when(F.col("_n") == 1, " asset").otherwise(" assets"))
    systems = systems.groupBy("request_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(place.alias("p"), counted_.alias("x")))), lambda s: s["x"]), ", ").alias("_systems"))
    own = assets.select(F.col("id").alias("_id"), F.col("name").alias("_name"), F.col("system").alias("_system"))
    rows = resolved.join(own, F.col("asset_id") == F.col("_id"), "left").join(bucket_counts(touched).drop("systems"), "request_id", "left").join(first, "request_id", "left").join(systems, "request_id", "left")
    n = {b: F.coalesce(F.col(b), F.lit(0)) for b in schemas.IMPACT_BUCKETS}
    has = lambda buckets: F.greatest(*[n[b] for b in buckets], F.lit(0)) > 0
    unknown, kind = F.col("asset_id").isNull(), F.lower("change_type")
    title = F.concat(F.initcap(F.replace(kind, F.lit("_"), F.lit(" "))), F.coalesce(F.concat(F.lit(" ("), F.col("target_name"), F.lit(" → "), F.nullif(F.col("new_name"), F.lit("")), F.lit(")")), F.lit("")))
    searched = F.concat(F.lit("'"), F.coalesce(F.nullif(F.col("target_name"), F.lit("")), F.lit("(unspecified)")), F.lit("'"))
    counted = F.array_compact(F.array(*[F.when(n[b] > 0, F.concat(n[b].cast("string"), F.lit(" " + b.replace("_", " ")))) for b in n]))
    about = F.concat(title, F.lit(" on '"), F.col("_name"), F.lit("' ("), F.col("asset_type"), F.lit(", "), F.col("_system"), F.lit("). "))
    executive = (
        F.when(unknown, F.concat(F.lit("No enterprise asset named "), searched, F.lit(" was found in the metadata graph. No impact analysis could be performed.")))
        .when(F.size(counted) == 0, F.concat(about, F.lit("No downstream assets are impacted by this change.")))
        .otherwise(F.concat(about, F.lit("Downstream impact: "), F.array_join(counted, ", "), F.lit(".")))
    )
    named = lambda text: F.concat(F.lit(text.split("{names}")[0]), F.coalesce("_names", F.lit("")), F.lit(text.split("{names}")[1])) if "{names}" in text else F.lit(text)
    listed = lambda *items: F.array_compact(F.array(*items))
    numbered = lambda a: F.transform(a, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    apply = F.concat(F.lit("Apply "), kind, F.lit(" to '"), F.col("_name"), F.lit("' ("), F.col("_system"), F.lit(")."))
    deploy = numbered(listed(apply, *[F.when(has(b), named(text)) for b, text, _ in STEPS], F.lit("Run end-to-end regression tests.")))
    back = numbered(listed(*[F.when(has(b), F.lit(text)) for b, _, text in reversed(STEPS)], F.concat(F.lit("Revert "), kind, F.lit(" on '"), F.col("_name"), F.lit("'.")), F.lit("Validate rollback by running regression tests.")))
    check = listed(F.lit("Verify source asset change applied successfully."), *[F.when(n[b] > 0, F.lit(text)) for b, text in CHECKS], F.lit("Run automated regression test suite."))
    total = F.coalesce("impacted", F.lit(0))
    change = F.concat(F.lit("Change type : "), F.upper("change_type"), F.coalesce(F.concat(F.lit(" ("), F.col("target_name"), F.lit(" -> "), F.nullif(F.col("new_name"), F.lit("")), F.lit(")")), F.lit("")))
    lost = F.concat_ws("\n", change, F.concat(F.lit("Source asset: not found (searched for "), searched, F.lit(")")), F.concat(F.lit("No matching enterprise asset named "), searched, F.lit(" was found in the metadata graph. Impact analysis could not be performed because no source asset could be resolved. All impact metrics are zero.")))
    found = F.concat_ws(
        "\n", change, F.concat(F.lit("Source asset: "), F.col("asset_id"), F.lit(" ("), F.col("asset_type"), F.lit(", "), F.col("_system"), F.lit(")")),
        F.concat(F.lit("Total impact: "), total.cast("string"), F.when(total == 1, " downstream asset").otherwise(" downstream assets")), F.concat(F.lit("Breakdown   : "), F.coalesce("_systems", F.lit("no downstream assets identified"))),
    )
    return rows.select(
        "request_id", executive.alias("executive_summary"), F.when(unknown, F.array(F.lit("Resolve the source asset before planning deployment."))).otherwise(deploy).alias("deployment_plan"), check.alias("validation_checklist"),
        F.when(unknown, F.array(F.lit("No rollback required (source asset was not resolved)."))).otherwise(back).alias("rollback_plan"), F.when(unknown, lost).otherwise(found).alias("summary"),
    )


def analyze(requests: DataFrame, assets: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """All of it: ``requests`` resolved and corrected, ``impact``, ``metrics`` and ``summaries``."""
    resolved = corrected(resolve(parse(requests), assets))
    touched = impact(resolved, assets, edges)
    return {"requests": resolved, "impact": touched, "buckets": bucket_counts(touched), "summaries": summaries(resolved, touched, assets)}

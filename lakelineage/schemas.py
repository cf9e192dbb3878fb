"""Types of the lineage graph: schemas of its two relations and its fixed domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSETS = (
    "id string, name string, asset_type string, system string, catalog string, `schema` string, owner string, criticality string, tags array<string>, source_file string, "
    "line_number int, metadata map<string,string>, properties map<string,string>, source_rank int, seq long"
)
EDGES = "source string, target string, relationship string, properties map<string,string>, source_rank int, edge_seq long"

# Systems, relationship types and criticalities.
SYSTEMS = ("database", "sql", "databricks", "pipeline", "powerbi", "api", "delta_lake", "unity_catalog", "adf", "fabric", "airflow", "synapse", "snowflake", "bigquery", "redshift")
RELATIONSHIPS = ("USES", "READS", "WRITES", "FEEDS", "CALLS", "REFERENCES", "DISPLAYS", "DEPENDS_ON", "JOINS", "GENERATES", "REFRESHES", "PUBLISHES", "OWNS", "CONTAINS", "TRIGGERS", "INGESTS_TO")
CRITICALITIES = ("low", "medium", "high", "critical")

# Asset types by impact bucket (coarse), and by estate bucket (fine). Types in neither have no coarse
# bucket and the last fine one.
IMPACT_BUCKETS = {
    "databricks_notebooks": ("databricks_notebook", "notebook", "spark_job", "job"),
    "databricks_pipelines": ("pipeline", "adf_pipeline", "fabric_pipeline", "airflow_dag", "dataflow"),
    "workflow_tasks": ("pipeline_task",),
    "sql_views": ("sql_view", "view", "materialized_view"),
    "sql_procedures": ("stored_procedure",),
    "sql_functions": ("sql_function", "function"),
    "adls_files": ("adls_file",),
    "powerbi_reports": ("report", "powerbi_report", "visual", "powerbi_visual", "dashboard", "powerbi_dashboard"),
    "semantic_models": ("semantic_model", "powerbi_dataset", "measure", "powerbi_measure"),
}
ESTATE_BUCKETS = {
    "database_tables": ("database", "database_table", "database_column", "primary_key", "foreign_key", "table", "column"),
    "views": ("view", "sql_view"),
    "materialized_views": ("materialized_view",),
    "stored_procedures": ("stored_procedure",),
    "functions": ("function", "sql_function"),
    "databricks_notebooks": ("databricks_notebook", "notebook"),
    "spark_jobs": ("spark_job", "job"),
    "delta_live_tables": ("delta_table", "delta_live_table"),
    "unity_catalog": ("unity_catalog_object",),
    "pipelines": ("pipeline", "pipeline_task", "dataflow"),
    "data_factory": ("adf_pipeline",),
    "airflow": ("airflow_dag",),
    "fabric_pipelines": ("fabric_pipeline",),
    "adls_files": ("adls_file",),
    "semantic_models": ("semantic_model", "powerbi_dataset", "measure", "powerbi_measure"),
    "powerbi_reports": ("report", "powerbi_report", "visual", "powerbi_visual"),
    "dashboards": ("dashboard", "powerbi_dashboard"),
    "apis": ("api", "rest_api"),
    "external_consumers": (),
}
CRITICAL_TYPES = ("table", "database", "database_table", "delta_table", "delta_live_table", "semantic_model", "powerbi_dataset", "pipeline", "adf_pipeline")
REVERSIBLE_TYPES = ("column", "table", "measure", "report", "database_table", "database_column", "primary_key", "foreign_key")
REVERSIBLE_EDGES = ("DEPENDS_ON", "USES", "DISPLAYS")
ASSET_TYPES = sorted({t for types in ESTATE_BUCKETS.values() for t in types})


def bucket(asset_type: Column, buckets: dict[str, tuple[str, ...]], default: str | None = None) -> Column:
    """Bucket of an asset type, as a lookup in a literal map."""
    pairs = [F.lit(x) for b, types in buckets.items() for t in types for x in (t, b)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), asset_type), F.lit(default))


def as_json(rows: DataFrame) -> DataFrame:
    """``json``: each row as an object with all its fields, nulls included, and maps and arrays nested."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))

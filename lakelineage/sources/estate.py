"""Further sources of the estate (workflows, file inventories, descriptor rows) and the merge of all sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelineage.functions.lineage import cut
from lakelineage.operators import graph

try:
    import yaml
except ImportError:  # workflows can't be read then
    yaml = None

# Names of inventory columns, in lower case.
INVENTORY = {
    "file_name": ("filename", "file_name"),
    "container": ("container",),
    "folder": ("folder",),
    "format": ("format",),
    "description": ("description",),
    "target": ("bronzetable", "bronze_table", "target", "target_table"),
}


def workflow_rows(text: str | None) -> list[tuple]:
    """(pipeline, task, order, notebook, depends_on) of a workflow file; nothing of a malformed one."""
    try:
        doc = yaml.safe_load(text or "") or {}
    except yaml.YAMLError:
        return []
    pipeline = doc.get("pipeline") if isinstance(doc, dict) else None
    if not isinstance(pipeline, dict) or not pipeline.get("name"):
        return []
    rows = []
    for t in pipeline.get("tasks") or []:
        if isinstance(t, dict) and t.get("name"):
            order = t.get("execution_order")
            rows.append((str(pipeline["name"]), str(t["name"]), order if isinstance(order, int) else None, t.get("notebook"), [str(x) for x in waits] if isinstance(waits := t.get("depends_on"), list) else []))
    return rows or [(str(pipeline["name"]), None, None, None, [])]


def workflow_tasks(files: DataFrame) -> DataFrame:
    """``pipeline``, ``task``, ``execution_order``, ``notebook``, ``depends_on`` of workflow files (``file``, ``text``)."""
    if yaml is None:
        raise ImportError("reading workflow files needs yaml")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for t in b["text"] for r in workflow_rows(t)], columns=["pipeline", "task", "execution_order", "notebook", "depends_on"])

    return files.select("text").mapInPandas(read, "pipeline string, task string, execution_order int, notebook string, depends_on array<string>")


def workflow_graph(tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pipelines and tasks, notebooks that they name, with TRIGGERS (to a pipeline's tasks, and from a task to those that wait for it) and CALLS edges."""
    pipeline, task = F.concat(F.lit("pipeline::"), "pipeline"), F.concat_ws("::", F.lit("pipeline_task"), "pipeline", "task")
    some = tasks.where("task IS NOT NULL")
    assets = tasks.select(pipeline.alias("id"), F.col("pipeline").alias("name"), F.lit("pipeline").alias("asset_type")).unionByName(some.select(task.alias("id"), F.col("task").alias("name"), F.lit("pipeline_task").alias("asset_type")))
    edges = some.select(pipeline.alias("source"), task.alias("target"), F.lit("TRIGGERS").alias("relationship"))
    waits = some.select("pipeline", task.alias("target"), F.explode("depends_on").alias("d")).select(F.concat_ws("::", F.lit("pipeline_task"), "pipeline", "d").alias("source"), "target", F.lit("TRIGGERS").alias("relationship"))
    named = some.withColumn("notebook", F.substring_index(F.regexp_replace("notebook", "^/+|/+$", ""), "/", -1)).where("notebook <> ''")
    calls = named.select(task.alias("source"), F.concat(F.lit("notebook::"), "notebook").alias("target"), F.lit("CALLS").alias("relationship"))
    assets = assets.unionByName(named.select(F.concat(F.lit("notebook::"), "notebook").alias("id"), F.col("notebook").alias("name"), F.lit("databricks_notebook").alias("asset_type")))
    return assets.distinct().withColumn("system", F.lit("databricks")), edges.unionByName(waits).unionByName(calls)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a file inventory; headers in any case, further columns left out, blank file names too."""
    raw = spark.read.csv(path, header=True)
    named = {c.strip().lower(): c for c in raw.columns}
    last = {v: [c for k, c in named.items() if k in names][-1:] for v, names in INVENTORY.items()}  # of several names for one field the last column counts
    rows = raw.select(*[F.nullif(F.trim(F.col(f"`{c[0]}`")), F.lit("")).alias(v) if c else F.lit(None).cast("string").alias(v) for v, c in last.items()])
    return rows.where("file_name IS NOT NULL")


def inventory_graph(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A file per distinct place, and INGESTS_TO edges to the tables that files are loaded into."""
    strip = lambda c: F.nullif(F.regexp_replace(c, "^/+|/+$", ""), F.lit(""))
    placed = rows.withColumn("id", F.concat(F.lit("adls_file::"), F.concat_ws("/", strip("container"), strip("folder"), "file_name")))
    once = placed.groupBy("id").agg(F.min("file_name").alias("name"), F.min("target").alias("target"))
    assets = once.select("id", "name", F.lit("adls_file").alias("asset_type"), F.lit("delta_lake").alias("system"))
    return assets, once.where("target IS NOT NULL").select(F.col("id").alias("source"), F.concat(F.lit("delta_table::"), "target").alias("target"), F.lit("INGESTS_TO").alias("relationship"))


def descriptor_graph(rows: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Assets and edges of descriptor rows: ``sql`` (type, catalog, schema, name, columns, reads), ``notebook`` (path, reads, writes) or ``pipeline`` (name, type, reads, writes, calls, publishes)."""
    if kind == "sql":
        id_ = F.concat(F.lit("sql::"), F.concat_ws(".", "catalog", F.coalesce("schema", F.lit("dbo")), "name"))
        named, lists = rows.withColumn("id", id_).withColumn("asset_type", F.col("type")), {"reads": ("sql::", "READS")}
    elif kind == "notebook":
        named, lists = rows.withColumn("id", F.concat(F.lit("notebook::"), "path")).withColumn("asset_type", F.lit("databricks_notebook")), {"reads": ("", "READS"), "writes": ("", "WRITES")}
    else:
        types = F.create_map(*[F.lit(x) for kv in {"adf": "adf_pipeline", "airflow": "airflow_dag", "fabric": "fabric_pipeline"}.items() for x in kv])  # fixed values
        named = rows.withColumn("id", F.concat(F.lit("pipeline::"), "name")).withColumn("asset_type", F.coalesce(F.try_element_at(types, F.lower("type")), F.lit("pipeline")))
        lists = {"reads": ("", "READS"), "writes": ("", "WRITES"), "calls": ("", "CALLS"), "publishes": ("", "PUBLISHES")}
    assets = named.select("id", "name", "asset_type") if "name" in named.columns else named.select("id", F.element_at(F.split("path", "/"), -1).alias("name"), "asset_type")
    edges = None
    for column, (prefix, relationship) in lists.items():
        if column in named.columns:
            part = named.select(F.col("id").alias("source"), F.explode(column).alias("t")).select("source", F.concat(F.lit(prefix), "t").alias("target"), F.lit(relationship).alias("relationship"))
            edges = part if edges is None else edges.unionByName(part)
    if kind == "sql" and "columns" in named.columns:
        cols = named.select("id", F.explode("columns").alias("c")).select(F.concat_ws(".", "id", "c").alias("column"), F.col("c").alias("name"), "id")
        assets = assets.unionByName(cols.select(F.col("column").alias("id"), "name", F.lit("database_column").alias("asset_type")))
        contains = cols.select(F.col("column").alias("source"), F.col("id").alias("target"), F.lit("CONTAINS").alias("relationship"))
        edges = contains if edges is None else edges.unionByName(contains)
    return assets.withColumn("system", F.lit({"sql": "sql", "notebook": "databricks"}.get(kind, "pipeline"))), edges


def owned(assets: DataFrame, source: str, owner: str | None = None, criticality: str = "medium") -> DataFrame:
    """``assets`` of a source with ``owner``, ``criticality`` and ``source_file`` where they have none of their own; ``medium`` counts as none."""
    known = lambda c: F.col(c).cast("string") if c in assets.columns else F.lit(None).cast("string")
    mine = F.nullif(known("criticality"), F.lit("medium"))
    return assets.withColumns({"owner": F.coalesce(F.nullif(known("owner"), F.lit("")), F.lit(owner).cast("string")), "criticality": F.coalesce(mine, F.lit(criticality)), "source_file": F.coalesce(F.nullif(known("source_file"), F.lit("")), F.lit(source))})


def placed(rows: DataFrame, name: str, *by: str) -> Column:
    """The source's own order; without one, the first eight bytes of the name, so that order is by name at any size."""
    if name in rows.columns:
        return F.col(name).cast("long").alias(name)
    return F.conv(F.rpad(F.hex(F.substring(F.encode(F.concat_ws(" ", *by), "utf-8"), 1, 7)), 14, "0"), 16, 10).cast("long").alias(name)


def load(sources: dict[str, Callable[[], tuple[DataFrame, DataFrame]]], registry: bool = False) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """Merged assets and edges of all sources in order, bridged and with reversed edges, and what failed.

    A source that fails is left out and reported; the first of equal assets and edges stays. A source is written to a
    table before it is merged, so one that fails on read is left out too, and its rows keep one order: by ``seq`` and
    ``edge_seq`` if it has them, else by name. As a ``registry``, all edges stay as they are, repeated ones too, and none is
    added. A source whose frames lack columns raises, since that is no fault of its data.
    """
    assets = edges = None
    failed: dict[str, str] = {}
    for rank, (name, source) in enumerate(sources.items()):
        try:
            a, e = source()
        except Exception as problem:  # noqa: BLE001  what a source raises stays its own
            failed[name] = f"{type(problem).__name__}: {problem}"
            continue
        a = a.select("id", "name", "asset_type", "system", F.lit(rank).alias("source_rank"), placed(a, "seq", "id"))
        e = e.select("source", "target", "relationship", F.lit(rank).alias("source_rank"), placed(e, "edge_seq", "source", "target", "relationship"))
        try:
            a, e = cut(a), cut(e)
        except AnalysisException:  # of the plans above, not of a source
            raise
        except Exception as problem:  # noqa: BLE001
            failed[name] = f"{type(problem).__name__}: {problem}"
            continue
        assets, edges = (a, e) if assets is None else (assets.unionByName(a), edges.unionByName(e))
    if assets is None:
        raise ValueError(f"no source could be read: {failed}")
    if registry:
        return graph.dedup_assets(assets), edges, failed
    assets, edges = graph.dedup_assets(assets), graph.dedup_edges(edges)
    for made in (graph.bridge_edges, graph.reverse_feeds):
        edges = edges.unionByName(made(assets, edges).withColumns({"source_rank": F.lit(99), "edge_seq": F.xxhash64("source", "target")}))
    return assets, edges, failed

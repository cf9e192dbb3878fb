"""Tables that notebooks read and write: from their metadata header, or from their source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakelineage.sources.files import lines

# Header lines and keys.
OPEN, CLOSE = r"(?i)^\s*#\s*(?!END\b)\w+\s+METADATA\s*$", r"(?i)^\s*#\s*END\s+\w+\s+METADATA\s*$"
MAGIC = r"(?i)^\s*#\s*MAGIC\s+"
SCALARS = ("notebook_name", "layer", "catalog", "schema", "execution_order")
LISTS = ("read_tables", "write_tables")
KEY = rf"(?i)^\s*#\s*({'|'.join(SCALARS + LISTS)})\s*[:=]\s*(.*?)\s*$"
ITEM = r"^\s*#\s*-?\s*(.*?)\s*,?\s*$"

# Idioms that read and write a table, with the table in the first group.
READS = (
    r"(?is)spark\.read\s*(?:\.\w+\([^)]*\))*\s*\.table\s*\(\s*['\"]([^'\"]+)['\"]\s*\)",
    r"(?i)spark\.table\s*\(\s*['\"]([^'\"]+)['\"]\s*\)",
    r"(?im)(?:^|[\s;])FROM\s+(\w[\w.]*\w)",
    r"(?i)\bJOIN\s+(\w[\w.]*\w)",
    r"(?i)DeltaTable\.forName\s*\([^,)]*,\s*['\"]([^'\"]+)['\"]\s*\)",
    r"(?i)DeltaTable\.forPath\s*\([^,)]*,\s*['\"]([^'\"]+)['\"]\s*\)",
    r"(?i)\bUSING\s+(\w[\w.]*\w)\s+(?:AS\s+\w+\s+)?ON\b",
)
WRITES = (
    r"(?i)\.saveAsTable\s*\(\s*['\"]([^'\"]+)['\"]\s*\)",
    r"(?i)\.insertInto\s*\(\s*['\"]([^'\"]+)['\"]\s*\)",
    r"(?i)(?<!read)\.write\s*(?:\.\w+(?:\([^)]*\))?)?\s*\.table\s*\(\s*['\"]([^'\"]+)['\"]\s*\)",
    r"(?i)\bCREATE\s+(?:OR\s+REPLACE\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(\w[\w.]*\w)",
    r"(?i)\bMERGE\s+INTO\s+(\w[\w.]*\w)",
    r"(?i)\bINSERT\s+(?:INTO|OVERWRITE)\s+(?:TABLE\s+)?(\w[\w.]*\w)",
)
IMPORT_LINE = r"(?im)^[ \t]*(?:from\s+[\w.]+\s+import\b|import\s+[\w, .]+).*$"
KEYWORDS = (
    "select", "where", "join", "inner", "left", "right", "outer", "full", "cross",
    "on", "group", "order", "having", "limit", "union", "except", "intersect", "with",
    "as", "values", "set", "using", "lateral", "tablesample", "unnest", "pivot", "unpivot",
    "qualify", "import",
)


def headers(files: DataFrame, merge_blocks: bool = False) -> DataFrame:
    """``file``, the scalar keys and the two lists of each notebook with a metadata header.

    By default the first header of a file counts; ``merge_blocks`` takes keys from all. A list goes on over the comment
    lines below its key, and keeps the first of equal entries.
    """
    rows = lines(files).withColumn("line", F.regexp_replace("line", MAGIC, "# "))
    rows = rows.withColumn("line", F.regexp_replace("line", r"^\s*#\s*#", "#"))
    w = Window.partitionBy("file").orderBy("pos")
    rows = rows.withColumns({"opened": F.sum(F.col("line").rlike(OPEN).cast("int")).over(w), "closed": F.sum(F.col("line").rlike(CLOSE).cast("int")).over(w)})
    rows = rows.where((F.col("opened") > F.col("closed")) & ~F.col("line").rlike(OPEN) & ~F.col("line").rlike(CLOSE))
    rows = rows if merge_blocks else rows.where("opened = 1")
    key = F.when(F.col("line").rlike(KEY), F.lower(F.regexp_extract("line", KEY, 1)))
    rows = rows.withColumn("own", key).withColumn("key", F.last("own", ignorenulls=True).over(w))
    value = F.when(F.col("own").isNotNull(), F.regexp_extract("line", KEY, 2)).otherwise(F.regexp_extract("line", ITEM, 1))
    rows = rows.withColumn("value", value).where("key IS NOT NULL")
    scalar = lambda k: F.min_by(F.nullif("value", F.lit("")), F.when((F.col("own") == k), F.col("pos")))
    first = lambda k: F.when(F.count_if(F.col("own") == k) > 0, scalar(k)).alias(k)

    def entries(k: str) -> Column:
        found = F.sort_array(F.collect_list(F.when(F.col("key") == k, F.struct("pos", F.split("value", r"\s*,\s*").alias("v")))))
        return F.array_distinct(F.filter(F.flatten(F.transform(found, lambda x: x["v"])), lambda v: v != "")).alias(k)

    out = rows.groupBy("file").agg(*[first(k) for k in SCALARS], *[entries(k) for k in LISTS])
    return out.withColumn("execution_order", F.expr("try_cast(execution_order AS INT)"))


def header_edges(found: DataFrame) -> DataFrame:
    """READS edges from tables to notebooks and WRITES edges from notebooks to tables."""
    id_ = F.concat(F.lit("notebook::"), F.coalesce("notebook_name", F.element_at(F.split("file", "/"), -1)))
    table = F.concat(F.lit("delta_table::"), F.col("t"))
    reads = found.select(id_.alias("target"), F.explode("read_tables").alias("t")).select(table.alias("source"), "target", F.lit("READS").alias("relationship"))
    return reads.unionByName(found.select(id_.alias("source"), F.explode("write_tables").alias("t")).select("source", table.alias("target"), F.lit("WRITES").alias("relationship")))


def header_graph(found: DataFrame, stubs: bool = True) -> tuple[DataFrame, DataFrame]:
    """Assets and edges of notebooks with headers: the notebooks, and, as ``stubs``, each table that any of them names, once."""
    id_ = F.coalesce("notebook_name", F.element_at(F.split("file", "/"), -1), F.lit("unknown_notebook"))
    assets = found.select(F.concat(F.lit("notebook::"), id_).alias("id"), id_.alias("name"), F.lit("databricks_notebook").alias("asset_type"), F.lit("databricks").alias("system"))
    edges = header_edges(found)
    if stubs:
        named = found.select(F.explode(F.array_distinct(F.concat("read_tables", "write_tables"))).alias("t")).distinct()
        tables = named.select(F.concat(F.lit("delta_table::"), "t").alias("id"), F.element_at(F.split("t", r"\."), -1).alias("name"), F.lit("delta_table").alias("asset_type"), F.lit("delta_lake").alias("system"))
        assets = assets.unionByName(tables)
    return assets, edges


def _tables(source: Column, patterns: tuple[str, ...]) -> Column:
    clean = F.regexp_replace(source, IMPORT_LINE, "")
    all_ = F.flatten(F.array(*[F.regexp_extract_all(clean, F.lit(p), F.lit(1)) for p in patterns]))
    return F.array_distinct(F.filter(all_, lambda t: ~F.lower(t).isin(*KEYWORDS)))


def reads(source: Column) -> Column:
    return _tables(source, READS)


def writes(source: Column) -> Column:
    return _tables(source, WRITES)


def code_of(cells: Column) -> Column:
    """Source of the code cells of a notebook, in order. ``cells``: array of (cell_type, source)."""
    return F.array_join(F.transform(F.filter(cells, lambda c: F.lower(c["cell_type"]) == "code"), lambda c: c["source"]), "\n")


def source_edges(notebooks: DataFrame) -> DataFrame:
    """Edges of notebooks (``path``, ``source``): READS and WRITES both go from the notebook to the table."""
    id_ = F.concat(F.lit("notebook::"), F.col("path"))
    edges = lambda tables, kind: notebooks.select(id_.alias("source"), F.explode(tables(F.col("source"))).alias("t")).select("source", F.concat(F.lit("delta_table::"), "t").alias("target"), F.lit(kind).alias("relationship"))
    return edges(reads, "READS").unionByName(edges(writes, "WRITES"))


def execution_order(path: Column) -> Column:
    """Number that a notebook's name begins with, before an underscore."""
    return F.nullif(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^(\d+)_", 1), F.lit("")).cast("int")


def notebook_name(name: Column, path: Column) -> Column:
    """The given name, else the last part of the path without a notebook's extension."""
    last = F.regexp_replace(F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1), r"(?i)\.(py|scala|r|sql|ipynb)$", "")
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(last, F.lit("")), F.lit("unknown_notebook"))


def workspace_folder(folder: Column, path: Column) -> Column:
    """The given folder, else that of the path; null for a path without one."""
    above = F.regexp_replace(F.regexp_replace(path, "/+$", ""), "/[^/]*$", "")
    return F.coalesce(F.nullif(folder, F.lit("")), F.when(F.contains(path, F.lit("/")), F.when(above == "", "/").otherwise(above)))


def catalogs_and_schemas(tables: Column) -> tuple[Column, Column]:
    """Sorted catalogs and schemas (with their catalog, if any) of table references of two parts or more."""
    parts = F.transform(tables, lambda t: F.split(t, r"\."))
    full, short = F.filter(parts, lambda p: F.size(p) >= 3), F.filter(parts, lambda p: F.size(p) == 2)
    schemas = F.concat(F.transform(full, lambda p: F.concat_ws(".", p[0], p[1])), F.transform(short, lambda p: p[0]))
    return F.sort_array(F.array_distinct(F.transform(full, lambda p: p[0]))), F.sort_array(F.array_distinct(schemas))

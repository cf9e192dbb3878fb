"""Semantic models (TMDL), report definitions (PBIR), and the dependencies that their expressions imply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakelineage.functions.lineage import cut
from lakelineage.operators import graph
from lakelineage.sources.files import blocks, lines, texts

INTERNAL = "^(DateTableTemplate_|LocalDateTable_)"
# Lines of a table file and of a relationships file.
OBJECT = r"^\t(column|measure|partition)\s+(.+?)\s*$"
PROPERTY = r"^\t{1,2}(\w+):\s+(.+?)\s*$"
ANNOTATION = r"^\t+annotation\s+(\w+)\s*=\s*(.+?)\s*$"
COLUMN_KEYS = ("dataType", "lineageTag", "formatString", "summarizeBy", "displayFolder", "dataCategory", "sortByColumn")
# References inside an expression.
COLUMN_REF = r"(?:'([^']+)'|([A-Za-z_]\w*))\[([^\]]+)\]"
MEASURE_REF = r"\[([^\]]+)\]"


def unquoted(x: Column) -> Column:
    return F.regexp_replace(F.trim(x), "^'(.*)'$", "$1")


def first_by_key(entries: Column) -> Column:
    """A map of an array of (pos, key, value): of each key the value that stands first."""
    sorted_ = F.array_sort(F.filter(entries, lambda e: e.isNotNull()))
    keys = F.array_distinct(F.transform(sorted_, lambda e: e["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.filter(sorted_, lambda e: e["k"] == k)[0]["v"]))


def objects(files: DataFrame) -> DataFrame:
    """A row per table, column, measure and partition of TMDL table files.

    ``table``, ``kind``, ``name``, ``expression`` (of measures and partitions), ``props`` and ``annotations`` (values by name, the first
    of each), ``is_hidden``. Lines belong to the last header at or above them; hierarchies and what they hold are left out.
    """
    rows = lines(files)
    table = rows.where(F.col("line").rlike("^table\\s")).groupBy("file").agg(F.min_by(F.regexp_extract("line", r"^table\s+(.+?)\s*$", 1), "pos").alias("table"))
    rows = blocks(rows, r"^(table\s|\t(column|measure|partition|hierarchy)\s)").where("block IS NOT NULL")
    head = F.col("pos") == F.col("block")
    prop = F.col("line").rlike(PROPERTY) & ~head
    text = F.when(~head & ~prop & F.col("line").rlike(r"^\t\t\t") & ~F.col("line").rlike(r"^\t+annotation\s"), F.struct("pos", F.regexp_replace("line", r"^\t+", "").alias("v")))
    entry = lambda form: F.struct("pos", F.regexp_extract("line", form, 1).alias("k"), F.regexp_extract("line", form, 2).alias("v"))
    grouped = rows.groupBy("file", "block").agg(
        F.max(F.when(head, F.col("line"))).alias("head"), F.collect_list(F.when(prop, entry(PROPERTY))).alias("props"), F.collect_list(F.when(F.col("line").rlike(ANNOTATION), entry(ANNOTATION))).alias("annotations"),
        F.max(F.col("line").rlike(r"^\t+isHidden\b")).alias("is_hidden"), F.sort_array(F.collect_list(text)).alias("body"),
    )
    grouped = grouped.where(~F.col("head").rlike(r"^\thierarchy\s")).withColumns({c: first_by_key(F.col(c)) for c in ("props", "annotations")})
    kind = F.when(F.col("head").rlike("^table"), "table").otherwise(F.regexp_extract("head", OBJECT, 1))
    rest = F.when(F.col("head").rlike("^table"), F.regexp_extract("head", r"^table\s+(.+?)\s*$", 1)).otherwise(F.regexp_extract("head", OBJECT, 2))
    name = F.when(kind.isin("measure", "partition"), F.regexp_extract(rest, r"^('(?:[^']|'')+'|[^=]+?)\s*=", 1)).otherwise(rest)
    own = F.trim(F.regexp_extract(rest, r"=\s*(.*)$", 1))
    expression = F.when(kind == "measure", F.when(own != "", own).otherwise(F.trim(F.array_join(F.transform("body", lambda x: x["v"]), "\n"))))
    expression = F.when(kind == "partition", F.nullif(F.array_join(F.transform("body", lambda x: x["v"]), "\n"), F.lit(""))).otherwise(expression)
    source = F.when(kind == "partition", own)
    out = grouped.select("file", kind.alias("kind"), unquoted(name).alias("name"), expression.alias("expression"), "props", "annotations", "is_hidden", source.alias("source_type"), F.col("block").alias("pos"))
    return out.join(table.select("file", unquoted(F.col("table")).alias("table")), "file")


def relationships(files: DataFrame) -> DataFrame:
    """``relationship_id``, ends, ``is_active``, ``cross_filter`` and ``from_cardinality``, with the defaults of the format."""
    rows = blocks(lines(files), r"^relationship\s").where("block IS NOT NULL")
    get = lambda k: F.max(F.when(F.col("line").rlike(rf"^\t+{k}:"), F.regexp_extract("line", rf"^\t+{k}:\s+(.+?)\s*$", 1)))
    out = rows.groupBy("file", "block").agg(F.max(F.when(F.col("pos") == F.col("block"), F.regexp_extract("line", r"^relationship\s+(.+?)\s*$", 1))).alias("relationship_id"), get("fromColumn").alias("f"), get("toColumn").alias("t"), get("isActive").alias("a"), get("crossFilteringBehavior").alias("c"), get("fromCardinality").alias("k"), get("toCardinality").alias("k2"), get("joinOnDateBehavior").alias("j"))
    end = lambda c, i: unquoted(F.substring_index(c, ".", 1) if i == 0 else F.substring_index(c, ".", -1))
    return out.select(
        "relationship_id", end("f", 0).alias("from_table"), end("f", 1).alias("from_column"), end("t", 0).alias("to_table"), end("t", 1).alias("to_column"), F.coalesce(F.lower("a") == "true", F.lit(True)).alias("is_active"),
        F.coalesce("c", F.lit("singleDirection")).alias("cross_filter"), F.coalesce("k", F.lit("many")).alias("from_cardinality"), F.col("k2").alias("to_cardinality"), F.col("j").alias("join_on_date"),
    )


VISUAL = "visual struct<visualType:string,query:struct<queryState:map<string,struct<projections:array<struct<field:struct<Column:struct<Expression:struct<SourceRef:struct<Entity:string>>,Property:string>,Measure:struct<Expression:struct<SourceRef:struct<Entity:string>>,Property:string>>,queryRef:string>>>>>>"


def visual_fields(visuals: DataFrame) -> DataFrame:
    """``file``, ``visual_type``, ``role``, ``place`` in it, ``entity``, ``property``, ``field_type`` of every projection. ``visuals``: ``file``, ``text``."""
    parsed = visuals.select("file", F.from_json("text", VISUAL).alias("j")).select("file", F.col("j.visual.visualType").alias("visual_type"), F.explode("j.visual.query.queryState").alias("role", "state"))
    fields = parsed.select("file", "visual_type", "role", F.posexplode("state.projections").alias("place", "p"))
    pick = lambda k: F.coalesce(F.col(f"p.field.Column.{k}"), F.col(f"p.field.Measure.{k}"))
    kind = F.when(F.col("p.field.Measure").isNotNull(), "measure").when(F.col("p.field.Column").isNotNull(), "column").otherwise("unknown")
    return fields.select("file", "visual_type", "role", "place", pick("Expression.SourceRef.Entity").alias("entity"), pick("Property").alias("property"), kind.alias("field_type"))


def pages(spark: SparkSession, manifest: str, page_files: str) -> DataFrame:
    """``page``, ``display_name``, ``place`` in the order of the manifest; pages without a file are left out."""
    order = spark.read.json(manifest, multiLine=True, schema="pageOrder array<string>").select(F.posexplode("pageOrder").alias("place", "page"))
    found = spark.read.json(page_files, multiLine=True, schema="name string, displayName string").select(F.col("name").alias("page"), F.col("displayName").alias("display_name"))
    return order.join(found, "page")


def without_internal(objs: DataFrame) -> DataFrame:
    """Objects of tables that the modelling tool doesn't make for itself."""
    return objs.where(~F.col("table").rlike(INTERNAL))


def load_model(spark: SparkSession, model: str, report: str, include_internal: bool = False) -> dict[str, DataFrame]:
    """``objects``, ``relationships``, ``pages``, ``fields`` and ``dependencies`` of a semantic model's and a report's folder."""
    objs = objects(texts(spark, f"{model}/definition/tables/*.tmdl"))
    objs = objs if include_internal else without_internal(objs)
    rels = relationships(texts(spark, f"{model}/definition/relationships.tmdl"))
    shown = visual_fields(texts(spark, f"{report}/definition/pages/*/visuals/*/visual.json"))
    shown = shown.withColumn("report", F.regexp_extract("file", "/pages/([^/]+)/visuals/", 1))
    found = pages(spark, f"{report}/definition/pages/pages.json", f"{report}/definition/pages/*/page.json")
    return {"objects": objs, "relationships": rels, "pages": found, "fields": shown, "dependencies": dependencies(objs, rels, shown)}


def payload(model: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables, columns, measures, relationships, reports and dependencies of a loaded model, each with the fields that it is asked for by."""
    objs = model["objects"]
    prop, note = (lambda k: F.try_element_at("props", F.lit(k))), (lambda k: F.try_element_at("annotations", F.lit(k)))
    common = (prop("lineageTag").alias("lineage_tag"), F.coalesce("is_hidden", F.lit(False)).alias("is_hidden"), prop("displayFolder").alias("display_folder"), note("Description").alias("description"), "annotations")
    kinds = objs.where("kind = 'partition'").groupBy("table").agg(F.min("source_type").alias("_type"))
    tables = objs.where("kind = 'table'").join(kinds, "table", "left").select("name", F.coalesce("_type", F.lit("unknown")).alias("source_type"), F.col("table").rlike(INTERNAL).alias("is_date_table"), *common)
    columns = objs.where("kind = 'column'").select(F.col("table").alias("table_name"), "name", prop("dataType").alias("data_type"), prop("summarizeBy").alias("summarize_by"), prop("dataCategory").alias("data_category"), prop("sortByColumn").alias("sort_by_column"), *common)
    measures = annotated_measures(objs).select(F.col("table").alias("table_name"), "name", "expression", prop("formatString").alias("format_string"), "referenced_tables", "referenced_columns", "referenced_measures", *common)
    return {"tables": tables, "columns": columns, "measures": measures, "relationships": model["relationships"], "reports": annotated_reports(model["pages"], model["fields"]), "dependencies": model["dependencies"]}


def annotated_measures(objs: DataFrame) -> DataFrame:
    """Measures with ``referenced_tables``, ``referenced_columns`` and ``referenced_measures`` that exist, each in order."""
    measures = objs.where("kind = 'measure'")
    columns = objs.where("kind = 'column'").select(F.concat("table", F.lit("["), "name", F.lit("]")).alias("ref"))
    names = measures.select(F.col("name").alias("ref"))
    tables = objs.where("kind = 'table'").select(F.col("name").alias("ref"))
    named = column_refs(F.col("expression"))
    asked = {"referenced_tables": (F.array_distinct(F.transform(named, lambda c: F.substring_index(c, "[", 1))), tables), "referenced_columns": (named, columns), "referenced_measures": (measure_refs(F.col("expression")), names)}
    out = measures
    for column, (refs, there) in asked.items():
        found = measures.select(F.col("table").alias("_table"), F.col("name").alias("_name"), F.explode(refs).alias("ref")).join(there, "ref", "left_semi")
        found = found.groupBy("_table", "_name").agg(F.sort_array(F.collect_set("ref")).alias(column))
        out = out.join(found, (F.col("name") == F.col("_name")) & F.col("table").eqNullSafe(F.col("_table")), "left").drop("_name", "_table").withColumn(column, F.coalesce(column, F.array().cast("array<string>")))
    return out


# Tokens of an M expression: texts, quoted names, brackets, commas, signs, names and the rest.
M_TOKEN = r"\"(?:[^\"]|\"\")*\"|#\"(?:[^\"]|\"\")*\"|//[^\n]*|=>|[\[\]{}(),=]|[\w.]+|[^\s\w]"


def m_steps(objs: DataFrame) -> DataFrame:
    """``file``, ``table``, ``name``, ``step`` (its number), ``body`` (its text) and ``is_result`` of each step of a partition's ``let``.

    The expression is cut into tokens, a row each; commas outside all brackets end a step, and ``in`` ends the steps.
    Windows run over one expression. A partition without ``let`` is one step, its result.
    """
    rows = objs.where("kind = 'partition' AND expression IS NOT NULL").select("file", "table", F.posexplode(F.regexp_extract_all("expression", F.lit(M_TOKEN), F.lit(0))).alias("pos", "t"))
    each = Window.partitionBy("file", "table").orderBy("pos")
    move = F.when(F.col("t").isin("[", "{", "("), 1).when(F.col("t").isin("]", "}", ")"), -1).otherwise(0)
    rows = rows.where(~F.col("t").startswith("//")).withColumn("depth", F.sum(move).over(each)).withColumn("top", (F.col("depth") == 0) & (move == 0))
    opens, ends = F.col("top") & (F.col("t") == "let"), F.col("top") & (F.col("t") == "in")
    cut_ = F.when(F.col("top") & (F.col("t") == ","), 1).when(ends, 1).otherwise(0)
    rows = rows.withColumns({"step": F.sum(cut_).over(each), "is_result": F.max(F.when(ends, 1).otherwise(0)).over(each) == 1}).where(~(opens | ends | (F.col("top") & (F.col("t") == ","))))
    first_sign = F.min(F.when(F.col("top") & (F.col("t") == "="), F.col("pos"))).over(Window.partitionBy("file", "table", "step"))
    rows = rows.withColumn("_sign", first_sign).groupBy("file", "table", "step").agg(
        F.max("is_result").alias("is_result"), F.min(F.when(F.col("pos") < F.col("_sign"), F.col("t"))).alias("name"),
        F.sort_array(F.collect_list(F.when(F.col("_sign").isNull() | (F.col("pos") > F.col("_sign")), F.struct("pos", "t")))).alias("_tokens"),
    )
    lone = F.max(F.col("is_result").cast("int")).over(Window.partitionBy("file", "table")) == 0  # no let
    return rows.select("file", "table", "step", F.coalesce("name", F.lit("in")).alias("name"), F.transform("_tokens", lambda x: x["t"]).alias("tokens"), (F.col("is_result") | lone).alias("is_result"))


def m_sources(objs: DataFrame) -> DataFrame:
    """``file``, ``table``, ``connector``, ``database``, ``schema``, ``item`` and ``steps`` of each partition: where its rows come from.

    References between steps are followed from the result to the source, over all partitions at once; each step that
    navigates names what it opens (``{[Name="x",Kind="Table"]}``).
    """
    steps = cut(m_steps(objs))
    key = lambda name: F.concat_ws("\u0001", "file", "table", name)
    known = steps.where("name <> 'in'").select("file", "table", F.col("name").alias("ref"))
    refs = steps.select("file", "table", "name", F.explode(F.array_distinct("tokens")).alias("ref")).where("name <> ref").join(known, ["file", "table", "ref"])
    edges = refs.select(key("name").alias("source"), key("ref").alias("target"), F.lit(0).cast("long").alias("edge_seq"))
    results = steps.where("is_result").select(key("name").alias("id"))
    used = graph.reach(edges, results).select("root", "id").unionByName(results.select(F.col("id").alias("root"), "id"))
    text = F.array_join("tokens", "")
    inside = lambda field: F.nullif(F.regexp_replace(F.regexp_extract(text, rf'\{{\[(?:.*,)?{field}=("(?:[^"]|"")*")', 1), '^"|"$', ""), F.lit(""))
    call = F.nullif(F.regexp_extract(text, r"^([A-Z]\w*\.\w+)\(", 1), F.lit(""))
    parts = steps.select("file", "table", key("name").alias("id"), F.coalesce(inside("Name"), inside("Item")).alias("_name"), F.coalesce(F.lower(inside("Kind")), F.when(inside("Item").isNotNull(), F.lit("table"))).alias("_kind"), inside("Schema").alias("_schema"), call.alias("_call"))
    goes_on = edges.select(F.col("source").alias("id")).distinct().withColumn("_on", F.lit(True))
    parts = parts.join(goes_on, "id", "left").withColumn("_call", F.when(F.col("_on").isNull(), F.col("_call")))  # a connector refers to no step
    of = lambda kind: F.max(F.when(F.col("_kind") == kind, F.col("_name")))
    return used.join(parts, "id").groupBy("file", "table", "root").agg(
        F.max("_call").alias("connector"), of("database").alias("database"), F.coalesce(of("schema"), F.max("_schema")).alias("schema"), F.coalesce(of("table"), of("view")).alias("item"), F.count("*").alias("steps")
    ).drop("root")


def m_edges(sources: DataFrame) -> DataFrame:
    """READS edges from model tables to the tables that their partitions open. ``sources``: of :func:`m_sources`."""
    there = F.concat(F.lit("delta_table::"), F.concat_ws(".", "schema", "item"))
    return sources.where("item IS NOT NULL").select(F.concat(F.lit("table::"), "table").alias("source"), there.alias("target"), F.lit("READS").alias("relationship")).distinct()


def annotated_reports(found: DataFrame, fields: DataFrame) -> DataFrame:
    """Pages (``page``) with the sorted ``used_measures``, ``used_columns`` and ``used_tables`` of their visuals."""
    sorted_ = lambda when, x, name: F.sort_array(F.collect_set(F.when(when, x))).alias(name)
    used = fields.groupBy(F.col("report").alias("page")).agg(
        sorted_(F.col("field_type") == "measure", F.col("property"), "used_measures"),
        sorted_(F.col("field_type") == "column", F.concat("entity", F.lit("["), "property", F.lit("]")), "used_columns"),
        sorted_(F.col("entity") != "", F.col("entity"), "used_tables"),
    )
    none = F.array().cast("array<string>")
    return found.join(used, "page", "left").withColumns({c: F.coalesce(c, none) for c in ("used_measures", "used_columns", "used_tables")})


def column_refs(expression: Column) -> Column:
    """``table[column]`` of every column that an expression names."""
    whole = F.regexp_extract_all(expression, F.lit(COLUMN_REF), F.lit(0))
    return F.array_distinct(F.transform(whole, lambda x: F.regexp_replace(x, r"^'([^']+)'", "$1")))


def measure_refs(expression: Column) -> Column:
    """Names in brackets that no table stands before; column references go first."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(expression, COLUMN_REF, " "), F.lit(MEASURE_REF), F.lit(1)))


def dependencies(objs: DataFrame, rels: DataFrame, fields: DataFrame) -> DataFrame:
    """``source_type``, ``source_name``, ``target_type``, ``target_name``: what columns, measures, relationships and reports depend on.

    ``fields``: ``report``, ``entity``, ``property``, ``field_type``. References count if what they name exists.
    """
    edge = lambda df, a, x, b, y: df.select(F.lit(a).alias("source_type"), F.col(x).alias("source_name"), F.lit(b).alias("target_type"), F.col(y).alias("target_name"))
    columns = objs.where("kind = 'column'").select(F.concat("table", F.lit("["), "name", F.lit("]")).alias("c"), "table")
    tables, measures = objs.where("kind = 'table'").select(F.col("name").alias("t")), objs.where("kind = 'measure'").select(F.col("name").alias("m"), "expression")
    on_column = measures.select("m", F.explode(column_refs(F.col("expression"))).alias("c"))
    on_table = on_column.select("m", F.substring_index("c", "[", 1).alias("t")).distinct().join(tables, "t", "left_semi")
    on_measure = measures.select("m", F.explode(measure_refs(F.col("expression"))).alias("o")).where("m <> o").join(measures.select(F.col("m").alias("o")), "o", "left_semi")
    shown = fields.where("field_type = 'measure'").select("report", F.col("property").alias("m")).distinct().join(measures.select("m"), "m", "left_semi")
    used = fields.where("entity IS NOT NULL").select("report", F.col("entity").alias("t")).distinct().join(tables, "t", "left_semi")
    picked = fields.where("field_type = 'column'").select("report", F.concat("entity", F.lit("["), "property", F.lit("]")).alias("c")).distinct().join(columns.select("c"), "c", "left_semi")
    parts = [
        edge(columns, "column", "c", "table", "table"), edge(on_column.join(columns.select("c"), "c", "left_semi"), "measure", "m", "column", "c"), edge(on_table, "measure", "m", "table", "t"), edge(on_measure, "measure", "m", "measure", "o"),
        edge(rels, "relationship", "relationship_id", "table", "from_table"), edge(rels, "relationship", "relationship_id", "table", "to_table"), edge(shown, "report", "report", "measure", "m"), edge(picked, "report", "report", "column", "c"),
        edge(used, "report", "report", "table", "t"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dependency_lookup(deps: DataFrame, kind: str, name: str) -> DataFrame:
    """Dependencies with the artifact on either side."""
    at = lambda side: (F.col(f"{side}_type") == kind) & (F.col(f"{side}_name") == name)
    return deps.where(at("source") | at("target"))


def model_graph(objs: DataFrame, deps: DataFrame, rels: DataFrame, found: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Assets and edges of a model and its report pages (``found``): ids by kind and name, the system by how a table is loaded."""
    loaded = objs.where("kind = 'partition'").groupBy("table").agg(F.max(F.col("source_type") == "m").alias("_m"))
    id_ = lambda kind, name: F.when(kind == "column", F.concat(F.lit("column::"), F.substring_index(name, "[", 1), F.lit("::"), F.regexp_extract(name, r"\[(.*)\]$", 1))).otherwise(F.concat(kind, F.lit("::"), name))
    named = objs.where("kind IN ('table','column','measure')").join(loaded, "table", "left")
    name = F.when(F.col("kind") == "column", F.concat("table", F.lit("["), "name", F.lit("]"))).otherwise(F.col("name"))
    system = F.when((F.col("kind") != "measure") & F.coalesce("_m", F.lit(False)), "database").otherwise("powerbi")
    assets = named.select(id_(F.col("kind"), name).alias("id"), "name", F.col("kind").alias("asset_type"), system.alias("system"))
    if found is not None:
        assets = assets.unionByName(found.select(F.concat(F.lit("report::"), "page").alias("id"), F.col("display_name").alias("name"), F.lit("report").alias("asset_type"), F.lit("powerbi").alias("system")))
    rel = F.when(F.col("source_type") == "report", F.when(F.col("target_type") == "measure", "DISPLAYS").otherwise("USES")).when((F.col("source_type") == "measure") & (F.col("target_type") == "column"), "USES").otherwise("DEPENDS_ON")
    edges = deps.where("source_type <> 'relationship'").select(id_(F.col("source_type"), F.col("source_name")).alias("source"), id_(F.col("target_type"), F.col("target_name")).alias("target"), rel.alias("relationship"))
    joins = rels.select(F.concat(F.lit("table::"), "from_table").alias("source"), F.concat(F.lit("table::"), "to_table").alias("target"), F.lit("REFERENCES").alias("relationship"))
    return assets, edges.unionByName(joins)

"""Queries of the text and metadata operators, over texts made from the tables, and of the stream extensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakelineage.functions import text
from lakelineage.operators import change, snapshot
from lakelineage.queries.lineage import GRAPH_SQL, estate
from lakelineage.queries.star import read, registry
from lakelineage.sources import estate as sources
from lakelineage.sources import files, notebooks, semantic_model, sql_ddl
from lakelineage.streaming import events as streams

QUERIES, ORACLE, plain = registry()


def query(sql):
    return plain(sql, False)


DDL = "'CREATE TABLE [dbo].[' || p_name || '] (a INT) -- CREATE VIEW x AS; ' || chr(10) || ';CREATE OR REPLACE VIEW dbo.v_' || p_partkey || ' AS SELECT * FROM dbo.\"' || p_name || '\" JOIN gone.t2 ON 1 = 1;' || ' /* ; */ CREATE PROCEDURE usp_' || p_partkey || ' AS BEGIN SELECT 1; SELECT 2; END;'"


def ddl_files(spark, d):
    return read(spark, d, "part").withColumn("p_name", F.replace("p_name", F.lit(" "), F.lit("_"))).select(F.col("p_partkey").cast("string").alias("file"), F.expr(DDL.replace("chr(10)", "'\\n'").replace("''", "''")).alias("text"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS file, kind, name FROM (SELECT p_partkey, unnest(['table', 'view', 'procedure']) AS kind, unnest([lower(replace(p_name, ' ', '_')), 'v_' || p_partkey, 'usp_' || p_partkey]) AS name FROM part)""")
def t_ddl_objects(spark, d):
    return sql_ddl.objects(sql_ddl.statements(ddl_files(spark, d))).select("file", "kind", "name")


@query("SELECT 'sql::dbo.' || lower(replace(p_name, ' ', '_')) AS source, 'sql::dbo.v_' || p_partkey AS target FROM part")
def t_table_refs(spark, d):
    return sql_ddl.references(sql_ddl.objects(sql_ddl.statements(ddl_files(spark, d)))).select("source", "target")


DAX = "'DIVIDE(SUM(part[' || p_brand || ']), [Total ' || p_size || '], CALCULATE([' || p_name || '], ''my part''[' || p_name || ']))'"


@query(f"""SELECT p_partkey, array_to_string(list_sort(list_distinct(['part[' || p_brand || ']', 'my part[' || p_name || ']'])), '|') AS columns,
 array_to_string(list_sort(list_distinct(regexp_extract_all(regexp_replace({DAX}, '(?:''[^'']+''|[A-Za-z_]\\w*)\\[[^\\]]+\\]', ' ', 'g'), '\\[([^\\]]+)\\]', 1))), '|') AS measures FROM part""")
def t_dax_refs(spark, d):
    dax = F.expr(DAX.replace("''", "\\'"))
    joined = lambda a: F.array_join(F.sort_array(a), "|")
    return read(spark, d, "part").select("p_partkey", joined(semantic_model.column_refs(dax)).alias("columns"), joined(semantic_model.measure_refs(dax)).alias("measures"))


CODE = "'from pyspark.sql import F' || chr(10) || 'df = spark.read.format(\"delta\").table(\"bronze.' || o_orderkey || '\")' || chr(10) || 'spark.sql(\"SELECT * FROM silver.t' || o_custkey || ' JOIN gold.x ON 1=1\")' || chr(10) || 'df.write.mode(\"overwrite\").saveAsTable(\"gold.o' || o_orderkey || '\")'"


@query("SELECT o_orderkey, 'bronze.' || o_orderkey || '|silver.t' || o_custkey || '|gold.x' AS reads, 'gold.o' || o_orderkey AS writes FROM orders")
def t_reads_writes(spark, d):
    code = F.expr(CODE.replace("chr(10)", "'\\n'"))
    return read(spark, d, "orders").select("o_orderkey", F.array_join(notebooks.reads(code), "|").alias("reads"), F.array_join(notebooks.writes(code), "|").alias("writes"))


HEADER = "'# Databricks notebook source' || chr(10) || '# MAGIC # LINEAGE METADATA' || chr(10) || '# MAGIC # NOTEBOOK_NAME: n' || c_custkey || chr(10) || '# LAYER=silver' || chr(10) || '# READ_TABLES: a.b, a.c' || chr(10) || '#   - a.' || c_custkey || chr(10) || '#   - a.b' || chr(10) || '# EXECUTION_ORDER: ' || c_nationkey || chr(10) || '# END LINEAGE METADATA' || chr(10) || '# LAYER=none'"


@query("SELECT 'n' || c_custkey AS notebook_name, 'silver' AS layer, 'a.b|a.c|a.' || c_custkey AS read_tables, c_nationkey AS execution_order FROM customer")
def t_header_block(spark, d):
    docs = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("file"), F.expr(HEADER.replace("chr(10)", "'\\n'")).alias("text"))
    return notebooks.headers(docs).select("notebook_name", "layer", F.array_join("read_tables", "|").alias("read_tables"), "execution_order")


@query(r"SELECT p_partkey, lower(regexp_replace(p_name || '_' || p_type || ' - ' || p_brand, '[\s_\-]+', '', 'g')) AS norm FROM part")
def t_norm_name(spark, d):
    return read(spark, d, "part").select("p_partkey", change.norm(F.expr("p_name || '_' || p_type || ' - ' || p_brand")).alias("norm"))


REQUEST = "CASE c_custkey % 6 WHEN 0 THEN 'Rename Revenue to Gross' || c_custkey WHEN 1 THEN 'Drop the c' || c_custkey || ' column from sales' WHEN 2 THEN 'rename c' || c_custkey || ' in customer_360 to buyer id' WHEN 3 THEN 'Delete table t' || c_custkey WHEN 4 THEN 'please modify the SQL view of t' || c_custkey ELSE 'hello' || c_custkey END"


@query("""SELECT c_custkey AS request_id, CASE c_custkey % 6 WHEN 0 THEN 'COLUMN_RENAME' WHEN 1 THEN 'COLUMN_DELETE' WHEN 2 THEN 'COLUMN_RENAME' WHEN 3 THEN 'TABLE_DELETE' WHEN 4 THEN 'VIEW_CHANGE' ELSE 'UNKNOWN' END AS change_type,
 CASE c_custkey % 6 WHEN 0 THEN 'Revenue' WHEN 1 THEN 'c' || c_custkey WHEN 2 THEN 'c' || c_custkey WHEN 3 THEN 't' || c_custkey END AS target_name, CASE c_custkey % 6 WHEN 0 THEN 'Gross' || c_custkey WHEN 2 THEN 'buyer id' END AS new_name,
 CASE c_custkey % 6 WHEN 1 THEN 'sales' WHEN 2 THEN 'customer_360' WHEN 4 THEN 't' || c_custkey END AS table_name, CASE c_custkey % 6 WHEN 4 THEN 'sql' END AS system FROM customer""")
def t_change_parse(spark, d):
    return change.parse(read(spark, d, "customer").select(F.col("c_custkey").alias("request_id"), F.expr(REQUEST).alias("request"))).drop("request")


@query(f"""WITH {GRAPH_SQL}, q AS (SELECT n_nationkey AS request_id, lower(regexp_replace(n_name, '[_ -]+', '', 'g')) AS n FROM nation),
 a AS (SELECT id, asset_type, seq, lower(regexp_replace(name, '[_ -]+', '', 'g')) AS n FROM assets)
 SELECT request_id, id AS asset_id, tier FROM (SELECT request_id, id, 2 AS tier, row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN asset_type = 'table' THEN 0 ELSE 1 END, seq) AS nth FROM q JOIN a USING (n)) WHERE nth = 1""")
def t_resolve_tiers(spark, d):
    asked = read(spark, d, "nation").select(F.col("n_nationkey").alias("request_id"), F.concat(F.lit("Drop the "), F.replace("n_name", F.lit(" "), F.lit("_")), F.lit(" table")).alias("request"))
    return change.resolve(change.parse(asked), estate(spark, d)[0]).select("request_id", "asset_id", "tier")


# Parts as assets beside the estate: columns and tables of their brands, by turns, under their names.
PARTS_SQL = f"""WITH {GRAPH_SQL}, things AS (SELECT id, name, asset_type, system, seq FROM assets UNION ALL
 SELECT CASE p_partkey % 2 WHEN 0 THEN 'table' ELSE 'column' END || '::' || replace(p_brand, '#', '') || '::' || p_partkey, p_name, CASE p_partkey % 2 WHEN 0 THEN 'table' ELSE 'column' END, CASE p_partkey % 3 WHEN 0 THEN 'sql' ELSE 'powerbi' END, 5000000000 + p_partkey FROM part),
 n AS (SELECT *, lower(regexp_replace(name, '[_ -]+', '', 'g')) AS n, lower(regexp_replace(id, '[_ -]+', '', 'g')) AS i FROM things WHERE name IS NOT NULL)"""


def parts_and_estate(spark, d):
    kind = "CASE p_partkey % 2 WHEN 0 THEN 'table' ELSE 'column' END"
    parts = read(spark, d, "part").selectExpr(f"{kind} || '::' || replace(p_brand, '#', '') || '::' || p_partkey AS id", "p_name AS name", f"{kind} AS asset_type", "CASE p_partkey % 3 WHEN 0 THEN 'sql' ELSE 'powerbi' END AS system", "5000000000 + p_partkey AS seq")
    return estate(spark, d)[0].select("id", "name", "asset_type", "system", "seq").unionByName(parts)


# Every part's name with a z in its last word, which no name contains: its own name is the closest one.
@plain(PARTS_SQL + """, own AS (SELECT n, asset_type, arg_min(id, seq) AS id FROM n WHERE i LIKE 'table::%' OR i LIKE 'column::%' GROUP BY 1, 2)
 SELECT p_partkey AS request_id, o.id AS asset_id, 4 AS tier FROM part JOIN own o ON o.n = lower(replace(p_name, ' ', '')) AND o.asset_type = CASE p_partkey % 2 WHEN 0 THEN 'table' ELSE 'column' END""", False)
def t_fuzzy(spark, d):
    name = F.regexp_replace(F.replace("p_name", F.lit(" "), F.lit("_")), "_(.)", "_$1z")
    asked = read(spark, d, "part").select(F.col("p_partkey").alias("request_id"), F.concat(F.lit("Drop the "), name, F.when(F.col("p_partkey") % 2 == 0, " table").otherwise(" column")).alias("request"))
    return change.resolve(change.parse(asked), parts_and_estate(spark, d)).select("request_id", "asset_id", "tier")


# Requests of the first three tiers, by turns: a part's name in its brand, in a brand that may have it, and its name with a word before it.
PREFER = "CASE WHEN asset_type IN ('column', 'database_column') THEN 1 ELSE 3 END"


@plain(PARTS_SQL + f""", q AS (SELECT p_partkey AS request_id, p_partkey % 3 AS form, lower(replace(p_name, ' ', '')) AS q, lower(CASE p_partkey % 3 WHEN 0 THEN replace(p_brand, '#', '') WHEN 1 THEN 'Brand' ELSE '' END) AS hint FROM part),
 c AS (SELECT request_id, id, CASE WHEN form = 0 AND lower(split_part(id, '::', 2)) = hint AND len(string_split(id, '::')) > 2 THEN 1 ELSE 2 END AS tier, CASE WHEN form < 2 AND NOT contains(i, hint) THEN 1 ELSE 0 END AS away, {PREFER} AS prefer, seq FROM q JOIN n ON n.n = q.q WHERE form < 2
  UNION ALL SELECT request_id, id, 3, 0, {PREFER}, seq FROM q JOIN (SELECT DISTINCT ON (n, asset_type) * FROM n ORDER BY seq) n ON contains('extra' || q.q, n.n) OR contains(n.n, 'extra' || q.q) WHERE form = 2)
 SELECT request_id, id AS asset_id, tier FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY tier, away, prefer, seq) AS nth FROM c) WHERE nth = 1""", False)
def t_resolve_forms(spark, d):
    bare = "replace(p_name, ' ', '_')"
    text = f"CASE p_partkey % 3 WHEN 0 THEN 'Drop the ' || {bare} || ' column from ' || replace(p_brand, '#', '') WHEN 1 THEN 'Drop the ' || {bare} || ' column of Brand' ELSE 'Drop the extra_' || {bare} || ' column' END"
    asked = read(spark, d, "part").select(F.col("p_partkey").alias("request_id"), F.expr(text).alias("request"))
    return change.resolve(change.parse(asked), parts_and_estate(spark, d)).select("request_id", "asset_id", "tier")


RELEVANCE = "list_filter(['small','gear','blue','rod'], lambda k: contains(lower(p_name), k))"


@query(f"""SELECT kind, name, score FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, name) AS place, max(score) OVER (PARTITION BY kind) AS best FROM
 (SELECT DISTINCT CASE p_size % 2 WHEN 0 THEN 'column' ELSE 'measure' END AS kind, p_name || ' ' || p_brand AS name, CAST(len({RELEVANCE}) AS INTEGER) AS score FROM part))
 WHERE place <= CASE kind WHEN 'column' THEN 10 ELSE 8 END AND (score > 0 OR best = 0)""")
def t_relevance_topk(spark, d):
    keys = text.keywords(F.lit("Please change the small gear, and the blue rod!"))
    keys = F.filter(keys, lambda k: k != "please")
    rows = read(spark, d, "part").select(F.when(F.col("p_size") % 2 == 0, "column").otherwise("measure").alias("kind"), F.concat_ws(" ", "p_name", "p_brand").alias("name"), text.relevance(F.col("p_name"), keys).alias("score")).distinct()
    return text.most_relevant(rows).select("kind", "name", "score")


# A model made of the tables: nations as tables, parts as columns, suppliers as measures, customers as report pages.
REQUESTS = "CASE c_custkey % 4 WHEN 0 THEN 'Please drop the gear columns of NATION_' || c_nationkey WHEN 1 THEN 'PROMO (Brand#1' || c_custkey % 10 || ') of nation_' || c_nationkey WHEN 2 THEN 'Rename Supplier#00000000' || c_custkey % 10 || ' and [small]' ELSE 'hello' END"
STOPS = ", ".join(f"'{w}'" for w in text.STOPWORDS)
MODEL_SQL = f"""WITH req AS (SELECT c_custkey AS request_id, {REQUESTS} AS request FROM customer),
 k AS (SELECT request_id, unnest(list_distinct(list_filter(string_split_regex(lower(request), '[\\s,.\\-/\\\\()\\[\\]"'']+'), lambda w: length(w) >= 3 AND w NOT IN ({STOPS})))) AS q FROM req),
 t AS (SELECT CAST(n_nationkey AS BIGINT) AS seq, n_name AS name, lower(n_name || ' ' || r_name || ' import') AS txt FROM nation JOIN region ON n_regionkey = r_regionkey),
 m AS (SELECT s_suppkey AS seq, s_name AS name, lower(s_name || ' SUM(NATION_' || s_nationkey || '[x]) NATION_' || s_nationkey) AS txt FROM supplier),
 c AS (SELECT p_partkey AS seq, p_name AS name, 'NATION_' || p_partkey % 25 AS tab, lower(p_name || ' ' || p_type || ' ' || p_brand) AS txt FROM part),
 ts AS (SELECT request_id, seq, name, count(*) AS score FROM k JOIN t ON contains(txt, q) GROUP BY ALL), ms AS (SELECT request_id, seq, name, count(*) AS score FROM k JOIN m ON contains(txt, q) GROUP BY ALL),
 tt AS (SELECT request_id, seq, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, name, seq) AS place FROM ts QUALIFY place <= 5
  UNION ALL SELECT request_id, seq, place FROM req, (SELECT seq, row_number() OVER (ORDER BY name, seq) AS place FROM t) WHERE place <= 5 AND request_id NOT IN (SELECT request_id FROM ts)),
 mm AS (SELECT request_id, seq, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, name, seq) AS place FROM ms QUALIFY place <= 8
  UNION ALL SELECT request_id, seq, place FROM req, (SELECT seq, row_number() OVER (ORDER BY name, seq) AS place FROM m) WHERE place <= 8 AND request_id NOT IN (SELECT request_id FROM ms)),
 cs AS (SELECT request_id, seq, sum(n) AS score FROM (SELECT request_id, seq, 1 AS n FROM k JOIN c ON contains(txt, q) UNION ALL SELECT request_id, c.seq, 1 FROM tt JOIN t USING (seq) JOIN c ON c.tab = t.name) GROUP BY ALL),
 cc AS (SELECT request_id, seq, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, name, seq) AS place FROM cs JOIN c USING (seq) QUALIFY place <= 10),
 near AS (SELECT request_id, name FROM tt JOIN t USING (seq)),
 rr AS (SELECT request_id, seq, row_number() OVER (PARTITION BY request_id ORDER BY seq) AS place FROM (SELECT DISTINCT request_id, CAST(n_nationkey AS BIGINT) AS seq FROM nation JOIN near ON name IN (n_name, 'NATION_' || (n_nationkey + 7) % 25)) QUALIFY place <= 5),
 pp AS (SELECT request_id, seq, row_number() OVER (PARTITION BY request_id ORDER BY seq) AS place FROM (
   SELECT request_id, c_custkey AS seq FROM customer JOIN near ON name = 'NATION_' || c_nationkey UNION SELECT request_id, c_custkey FROM customer JOIN (SELECT request_id, name FROM mm JOIN m USING (seq)) x ON x.name = 'Supplier#' || lpad(CAST(c_custkey % 100 AS VARCHAR), 9, '0')) QUALIFY place <= 4),
 found AS (SELECT request_id, 'table' AS kind, seq, place FROM tt UNION ALL SELECT request_id, 'measure', seq, place FROM mm UNION ALL SELECT request_id, 'column', seq, place FROM cc
  UNION ALL SELECT request_id, 'relationship', seq, place FROM rr UNION ALL SELECT request_id, 'report', seq, place FROM pp)"""


def model_of(spark, d):
    region = read(spark, d, "region")
    nation = read(spark, d, "nation")
    return snapshot.snapshot({
        "table": nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).selectExpr("cast(n_nationkey AS bigint) AS seq", "n_name AS name", "r_name AS description", "'import' AS source_type"),
        "column": read(spark, d, "part").selectExpr("p_partkey AS seq", "'NATION_' || p_partkey % 25 AS table_name", "p_name AS name", "p_type AS data_type", "p_brand AS description"),
        "measure": read(spark, d, "supplier").selectExpr("s_suppkey AS seq", "'M' AS table_name", "s_name AS name", "'SUM(NATION_' || s_nationkey || '[x])' AS expression", "array('NATION_' || s_nationkey) AS referenced_tables"),
        "relationship": nation.selectExpr("cast(n_nationkey AS bigint) AS seq", "n_name AS from_table", "'id' AS from_column", "'NATION_' || (n_nationkey + 7) % 25 AS to_table", "'id' AS to_column"),
        "report": read(spark, d, "customer").selectExpr("c_custkey AS seq", "c_name AS page_name", "c_name AS display_name", "array('Supplier#' || lpad(cast(c_custkey % 100 AS string), 9, '0')) AS used_measures", "array('NATION_' || c_nationkey) AS used_tables"),
    })


def requests_of(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("request_id"), F.expr(REQUESTS).alias("request"))


@query(MODEL_SQL + " SELECT request_id, kind, seq, CAST(place AS INTEGER) AS place FROM found")
def t_snapshot(spark, d):
    return snapshot.relevant(requests_of(spark, d), model_of(spark, d))


@query(MODEL_SQL + """, shown AS (SELECT request_id, kind, place, 1 AS words FROM found WHERE kind IN ('table', 'relationship') UNION ALL SELECT request_id, kind, place, len(string_split(name, ' ')) FROM found JOIN c USING (seq) WHERE kind = 'column'
 UNION ALL SELECT request_id, kind, place, 3 FROM found WHERE kind = 'measure' UNION ALL SELECT request_id, kind, place, 2 FROM found WHERE kind = 'report')
 SELECT request_id, count(*) AS lines, CAST(max(spent) AS BIGINT) AS spent FROM (SELECT request_id, sum(CAST(floor(words * 1.3) AS INTEGER)) OVER (PARTITION BY request_id ORDER BY list_position(['table', 'relationship', 'column', 'measure', 'report'], kind), place) AS spent FROM shown) WHERE spent <= 40 GROUP BY 1""")
def t_budget(spark, d):
    shot, asked = model_of(spark, d), requests_of(spark, d)
    lines = snapshot.within_budget(snapshot.shown(snapshot.relevant(asked, shot), shot), 40)
    return lines.groupBy("request_id").agg(F.count("*").alias("lines"), F.max("spent").alias("spent"))


@query("SELECT p_partkey, array_to_string(list_filter([p_name || ' View', 'Notebook ' || p_brand, p_type], lambda i: NOT contains(lower(i), 'view') AND NOT contains(lower(i), 'gear')), '|') AS kept FROM part")
def t_scrub(spark, d):
    items = F.array(F.concat("p_name", F.lit(" View")), F.concat(F.lit("Notebook "), "p_brand"), F.col("p_type"))
    return read(spark, d, "part").select("p_partkey", F.array_join(text.scrub(items, F.array(F.lit("VIEW"), F.lit("gear"))), "|").alias("kept"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def t_json_fields(spark, d):
    return read(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""SELECT file, block, count(*) AS n FROM (SELECT file, last_value(CASE WHEN regexp_matches(line, '^[A-M]') THEN pos END IGNORE NULLS) OVER (PARTITION BY file ORDER BY pos) AS block FROM
 (SELECT CAST(doc_id AS VARCHAR) AS file, CAST(unnest(generate_series(0, len(ls) - 1)) AS INTEGER) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))) GROUP BY 1, 2""")
def t_line_blocks(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), "text")
    return files.blocks(files.lines(docs), "^[A-M]").groupBy("file", "block").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT 'p' || n_nationkey AS p FROM nation) SELECT 'pipeline::' || p AS source, 'pipeline_task::' || p || '::' || t AS target, 'TRIGGERS' AS relationship FROM p, (VALUES ('a'), ('b')) v(t)
 UNION ALL SELECT 'pipeline_task::' || p || '::a', 'pipeline_task::' || p || '::b', 'TRIGGERS' FROM p UNION ALL SELECT 'pipeline_task::' || p || '::a', 'notebook::nb', 'CALLS' FROM p""")
def t_workflow_yaml(spark, d):
    yml = F.format_string("pipeline:\n  name: p%s\n  tasks:\n    - name: a\n      execution_order: 1\n      notebook: /x/nb/\n      depends_on: []\n    - name: b\n      depends_on: [a]\n", F.col("n_nationkey"))
    docs = read(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("file"), yml.alias("text"))
    return sources.workflow_graph(sources.workflow_tasks(docs))[1]


@query("SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS value FROM events GROUP BY 1, 2")
def x_event_windows(spark, d):
    return streams.per_window(read(spark, d, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("""SELECT user_id, count(*) AS sessions FROM (SELECT user_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE THEN 1 END AS first FROM events)
 WHERE first = 1 GROUP BY 1""")
def x_event_sessions(spark, d):
    return streams.sessions(read(spark, d, "events")).groupBy("user_id").agg(F.count("*").alias("sessions"))


MODEL = """format_string('table T%d\\n\\tisHidden\\n\\tlineageTag: t%d\\n\\n\\tmeasure ''Total %d'' = SUM(T%d[Size])\\n\\t\\tformatString: 0\\n\\t\\tannotation Description = \"of %d\"\\n\\n\\tmeasure Twice =\\n\\t\\t\\t[Total %d] * 2\\n\\n\\tcolumn Size\\n\\t\\tdataType: int64\\n\\t\\tlineageTag: c%d\\n\\t\\tvariation V\\n\\t\\t\\tlineageTag: v\\n\\n\\thierarchy H\\n\\t\\tlineageTag: h\\n\\t\\tlevel Year\\n\\t\\t\\tlineageTag: l\\n\\n\\tpartition P = m\\n\\t\\tmode: import\\n', k, k, k, k, k, k, k)"""


def model_files(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("file"), F.expr(MODEL.replace("k, k, k, k, k, k, k", ", ".join(["p_partkey"] * 7))).alias("text"))


@query("""SELECT 'T' || p_partkey AS "table", kind, CASE kind WHEN 'table' THEN 'T' || p_partkey WHEN 'measure' THEN 'Total ' || p_partkey ELSE name END AS name, CASE kind WHEN 'table' THEN 't' || p_partkey WHEN 'column' THEN 'c' || p_partkey END AS tag,
 CASE kind WHEN 'measure' THEN '"of ' || p_partkey || '"' END AS description, CASE kind WHEN 'measure' THEN 'SUM(T' || p_partkey || '[Size])' WHEN 'second' THEN '[Total ' || p_partkey || '] * 2' END AS expression FROM part,
 (VALUES ('table', NULL), ('measure', NULL), ('second', 'Twice'), ('column', 'Size'), ('partition', 'P')) v(kind, name)""".replace("kind, CASE kind WHEN 'table' THEN 'T' ||", "CASE kind WHEN 'second' THEN 'measure' ELSE kind END AS kind, CASE kind WHEN 'table' THEN 'T' ||"))
def t_model_objects(spark, d):
    tag = lambda c, k: F.try_element_at(c, F.lit(k))
    return semantic_model.objects(model_files(spark, d)).select("table", "kind", "name", tag(F.col("props"), "lineageTag").alias("tag"), tag(F.col("annotations"), "Description").alias("description"), "expression")


@query("""SELECT CASE n WHEN 1 THEN 'Total ' || p_partkey ELSE 'Twice' END AS name, 'T' || p_partkey AS "table", CASE n WHEN 1 THEN 'T' || p_partkey ELSE '' END AS tables, CASE n WHEN 1 THEN 'T' || p_partkey || '[Size]' ELSE '' END AS columns,
 CASE n WHEN 1 THEN '' ELSE 'Total ' || p_partkey END AS measures FROM part, (VALUES (1), (2)) v(n)""")
def t_model_annotated(spark, d):
    objs = semantic_model.objects(model_files(spark, d))
    joined = lambda c, n: F.array_join(c, "|").alias(n)
    return semantic_model.annotated_measures(objs).select("name", "table", joined("referenced_tables", "tables"), joined("referenced_columns", "columns"), joined("referenced_measures", "measures"))


# A partition for every part: three ways of opening its table, by turns, with commas in texts and steps that lead nowhere.
OPENED = """CASE p_partkey % 3 WHEN 0 THEN format_string('let\n    Source = Databricks.Catalogs("host, %d", "/w", [A=null, B="x"]),\n    db_Database = Source{[Name="ws",Kind="Database"]}[Data],\n    g = db_Database{[Name="gold",Kind="Schema"]}[Data],\n    Unused = Source{[Name="no",Kind="Table"]}[Data],\n    T = g{[Name="t%d",Kind="Table"]}[Data]\nin\n    T', p_partkey, p_partkey)
 WHEN 1 THEN format_string('let\n    Source = Sql.Database("server", "db"),\n    #"Opened it" = Source{[Schema="dbo",Item="t%d"]}[Data], // a, comment\n    Kept = Table.SelectRows(#"Opened it", each [Size] > 1)\nin\n    Kept', p_partkey)
 ELSE 'Csv.Document(File.Contents("a,b.csv"))' END"""


@query("""SELECT 'T' || p_partkey AS "table", CASE p_partkey % 3 WHEN 0 THEN 'Databricks.Catalogs' WHEN 1 THEN 'Sql.Database' ELSE 'Csv.Document' END AS connector, CASE p_partkey % 3 WHEN 0 THEN 'ws' END AS database,
 CASE p_partkey % 3 WHEN 0 THEN 'gold' WHEN 1 THEN 'dbo' END AS schema, CASE WHEN p_partkey % 3 < 2 THEN 't' || p_partkey END AS item, CASE p_partkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 1 END + CASE WHEN p_partkey % 3 < 2 THEN 1 ELSE 0 END AS steps FROM part""")
def t_m_sources(spark, d):
    text_ = F.concat(F.format_string("table T%d\n\tlineageTag: x\n\n\tpartition P = m\n\t\tmode: import\n\t\tsource =\n", F.col("p_partkey")), F.concat(F.lit("\t\t\t\t"), F.replace(F.expr(OPENED), F.lit("\n"), F.lit("\n\t\t\t\t"))), F.lit("\n"))
    docs = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("file"), text_.alias("text"))
    return semantic_model.m_sources(semantic_model.objects(docs)).drop("file")

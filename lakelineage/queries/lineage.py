"""Graph queries. The estate is made of the test tables: a node per key, an edge per reference.

Two regions feed each other, so there is a cycle; some edges go to ids that are no assets; ids occur twice and names
are shared, as the operators under test need it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lakelineage import schemas
from lakelineage.operators import graph as g
from lakelineage.queries.star import read, registry

QUERIES, ORACLE, plain = registry()

TYPES = ("delta_table", "notebook", "measure", "column", "sql_view", "report", "pipeline_task", "table")
GRAPH_SQL = """
assets AS (
  SELECT 'region::' || r_regionkey AS id, r_name AS name, 'database' AS asset_type, 'database' AS system, 0 AS source_rank, CAST(r_regionkey AS BIGINT) AS seq FROM region
  UNION ALL SELECT 'nation::' || n_nationkey, n_name, 'table', 'sql', 1, 100 + n_nationkey FROM nation
  UNION ALL SELECT 'customer::' || c_custkey, c_name, ['delta_table','notebook','measure','column','sql_view','report','pipeline_task','table'][1 + c_custkey % 8],
    CASE WHEN c_custkey % 8 IN (2, 3, 5, 7) THEN 'powerbi' ELSE 'databricks' END, 2, 1000 + c_custkey FROM customer
  UNION ALL SELECT 'supplier::' || s_suppkey, s_name, 'pipeline', 'pipeline', 3, 1000000000 + s_suppkey FROM supplier
  UNION ALL SELECT 'order::' || o_orderkey, 'Order ' || o_orderkey, 'rest_api', 'api', 4, 2000000000 + o_orderkey FROM orders
), edges AS (
  SELECT 'region::' || n_regionkey AS source, 'nation::' || n_nationkey AS target, 'CONTAINS' AS relationship, false AS unresolved, 0 AS source_rank, CAST(n_nationkey AS BIGINT) AS edge_seq FROM nation
  UNION ALL SELECT 'nation::' || c_nationkey, 'customer::' || c_custkey, 'FEEDS', false, 1, 1000 + c_custkey FROM customer
  UNION ALL SELECT 'nation::' || s_nationkey, 'supplier::' || s_suppkey, 'USES', false, 2, 1000000000 + s_suppkey FROM supplier
  UNION ALL SELECT 'customer::' || o_custkey, 'order::' || o_orderkey, 'WRITES', false, 3, 2000000000 + o_orderkey FROM orders
  UNION ALL SELECT 'supplier::' || s_suppkey, 'ghost::' || (s_suppkey % 7), 'CALLS', s_suppkey % 2 = 0, 4, 3000000000 + s_suppkey FROM supplier
), looped AS (
  SELECT source, target FROM edges UNION ALL SELECT 'region::' || r_regionkey, 'region::' || (1 - r_regionkey) FROM region WHERE r_regionkey < 2
)"""
# Two kinds of cycles with nations in between: the first two regions, and customers with some of their orders.
KNOTTED_SQL = GRAPH_SQL + """, knotted AS (
  SELECT source, target, edge_seq FROM edges UNION ALL SELECT 'region::' || r_regionkey, 'region::' || (1 - r_regionkey), 9000000000 + r_regionkey FROM region WHERE r_regionkey < 2
  UNION ALL SELECT 'order::' || o_orderkey, 'customer::' || o_custkey, 9100000000 + o_orderkey FROM orders WHERE o_orderkey % 50 = 0
), hop AS (SELECT DISTINCT source, target FROM knotted
), far AS (SELECT source AS root, target AS id FROM hop UNION SELECT f.root, h.target FROM far f JOIN hop h ON h.source = f.id
), ring AS (SELECT a.root AS id, min(a.id) AS component FROM far a JOIN far b ON b.root = a.id AND b.id = a.root GROUP BY 1
), line AS (SELECT DISTINCT coalesce(s.component, source) AS source, coalesce(t.component, target) AS target FROM hop LEFT JOIN ring s ON s.id = source LEFT JOIN ring t ON t.id = target WHERE coalesce(s.component, source) <> coalesce(t.component, target)
), long AS (SELECT source AS node, target AS id, 1 AS depth FROM line UNION SELECT l.node, e.target, l.depth + 1 FROM long l JOIN line e ON e.source = l.id
), deep AS (SELECT a.id, a.seq, coalesce(r.component, a.id) AS node, coalesce(m, 0) AS depth FROM assets a LEFT JOIN ring r ON r.id = a.id LEFT JOIN (SELECT node, CAST(max(depth) AS INTEGER) AS m FROM long GROUP BY 1) x ON x.node = coalesce(r.component, a.id)
)"""
REACH = """, reach AS (SELECT source AS root, target AS id, 1 AS depth FROM {e} WHERE {where} UNION SELECT r.root, e.target, r.depth + 1 FROM reach r JOIN {e} e ON e.source = r.id WHERE r.depth < 8),
 found AS (SELECT root, id, CAST(min(depth) AS INTEGER) AS depth FROM reach WHERE id <> root GROUP BY 1, 2)"""


def query(sql: str | None, reach: str | None = None, edges: str = "looped"):
    """SQL over the estate; ``reach``: condition on the roots for a recursive closure."""
    recursive = REACH.format(e=edges, where=reach) if reach else ""
    return plain(None if sql is None else f"WITH RECURSIVE {GRAPH_SQL}{recursive}\n{sql}", False)


def estate(spark, d):
    t = {n: read(spark, d, n) for n in ("region", "nation", "customer", "supplier", "orders")}
    key = lambda kind, c: F.concat(F.lit(f"{kind}::"), F.col(c).cast("string"))
    pick = F.element_at(F.array(*map(F.lit, TYPES)), (1 + F.col("c_custkey") % 8).cast("int"))
    bi = F.when((F.col("c_custkey") % 8).isin(2, 3, 5, 7), "powerbi").otherwise("databricks")
    kinds = [
        ("region", "region", "r_regionkey", F.col("r_name"), F.lit("database"), F.lit("database"), 0),
        ("nation", "nation", "n_nationkey", F.col("n_name"), F.lit("table"), F.lit("sql"), 100),
        ("customer", "customer", "c_custkey", F.col("c_name"), pick, bi, 1000),
        ("supplier", "supplier", "s_suppkey", F.col("s_name"), F.lit("pipeline"), F.lit("pipeline"), 1_000_000_000),
        ("order", "orders", "o_orderkey", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), F.lit("rest_api"), F.lit("api"), 2_000_000_000),
    ]
    assets = None
    for rank, (kind, table, k, name, type_, system, base) in enumerate(kinds):
        part = t[table].select(key(kind, k).alias("id"), name.alias("name"), type_.alias("asset_type"), system.alias("system"), F.lit(rank).alias("source_rank"), (F.col(k).cast("long") + base).alias("seq"))
        assets = part if assets is None else assets.unionByName(part)
    ghost = F.concat(F.lit("ghost::"), (F.col("s_suppkey") % 7).cast("string"))
    links = [
        ("nation", key("region", "n_regionkey"), key("nation", "n_nationkey"), "CONTAINS", F.lit(False), "n_nationkey", 0),
        ("customer", key("nation", "c_nationkey"), key("customer", "c_custkey"), "FEEDS", F.lit(False), "c_custkey", 1000),
        ("supplier", key("nation", "s_nationkey"), key("supplier", "s_suppkey"), "USES", F.lit(False), "s_suppkey", 1_000_000_000),
        ("orders", key("customer", "o_custkey"), key("order", "o_orderkey"), "WRITES", F.lit(False), "o_orderkey", 2_000_000_000),
        ("supplier", key("supplier", "s_suppkey"), ghost, "CALLS", F.col("s_suppkey") % 2 == 0, "s_suppkey", 3_000_000_000),
    ]
    edges = None
    for rank, (table, source, target, kind, unresolved, k, base) in enumerate(links):
        part = t[table].select(source.alias("source"), target.alias("target"), F.lit(kind).alias("relationship"), unresolved.alias("unresolved"), F.lit(rank).alias("source_rank"), (F.col(k).cast("long") + base).alias("edge_seq"))
        edges = part if edges is None else edges.unionByName(part)
    return assets, edges


def looped(spark, d, edges):
    """The edges and a cycle between the first two regions."""
    r = read(spark, d, "region").where("r_regionkey < 2")
    loop = r.selectExpr("'region::' || r_regionkey AS source", "'region::' || (1 - r_regionkey) AS target", "'FEEDS' AS relationship", "false AS unresolved", "9 AS source_rank", "9000000000 + r_regionkey AS edge_seq")
    return edges.unionByName(loop)


def knotted(spark, d, edges):
    """:func:`looped`, and cycles of customers with some of their orders, so that nations lie between cycles."""
    back = read(spark, d, "orders").where("o_orderkey % 50 = 0")
    back = back.selectExpr("'order::' || o_orderkey AS source", "'customer::' || o_custkey AS target", "'FEEDS' AS relationship", "false AS unresolved", "9 AS source_rank", "9100000000 + o_orderkey AS edge_seq")
    return looped(spark, d, edges).unionByName(back)


def some(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def regions(spark, d):
    return read(spark, d, "region").selectExpr("'region::' || r_regionkey AS id")


@query("SELECT source AS id, 'downstream' AS direction, target AS neighbor, relationship FROM edges WHERE source LIKE 'nation::%' UNION ALL SELECT target, 'upstream', source, relationship FROM edges WHERE target LIKE 'nation::%'")
def g_neighbors(spark, d):
    return g.neighbors(estate(spark, d)[1], read(spark, d, "nation").selectExpr("'nation::' || n_nationkey AS id"))


@query("SELECT root, f.id, name FROM found f JOIN assets a ON a.id = f.id", "source LIKE 'region::%'")
def g_downstream(spark, d):
    assets, edges = estate(spark, d)
    return g.known_only(g.reach(looped(spark, d, edges), regions(spark, d)), assets).select("root", "id", "name")


@query("SELECT root, f.id FROM found f JOIN assets a ON a.id = f.id", "source LIKE 'order::%'", "(SELECT target AS source, source AS target FROM looped)")
def g_upstream(spark, d):
    assets, edges = estate(spark, d)
    return g.known_only(g.reach(g.turn(looped(spark, d, edges)), assets.where("id LIKE 'order::%'")), assets).select("root", "id")


@query("SELECT root, id, depth FROM found", "source LIKE 'region::%'")
def g_downstream_depth(spark, d):
    _, edges = estate(spark, d)
    return g.reach(looped(spark, d, edges), regions(spark, d)).select("root", "id", "depth")


SYSTEMS_SQL = ", ".join(f"('{s}')" for s in schemas.SYSTEMS)


@query(f"SELECT r.root, s.system, count(a.id) AS n FROM (SELECT DISTINCT root FROM found) r CROSS JOIN (VALUES {SYSTEMS_SQL}) s(system) LEFT JOIN found f ON f.root = r.root LEFT JOIN assets a ON a.id = f.id AND a.system = s.system GROUP BY 1, 2", "source LIKE 'region::%'")
def g_full_impact(spark, d):
    assets, edges = estate(spark, d)
    return g.full_impact(g.reach(looped(spark, d, edges), regions(spark, d)), assets)


BOTH = """WITH RECURSIVE {graph}, down AS (SELECT source AS root, target AS id, 1 AS depth FROM looped WHERE source LIKE 'nation::%' UNION SELECT r.root, e.target, r.depth + 1 FROM down r JOIN looped e ON e.source = r.id WHERE r.depth < 8),
 up AS (SELECT target AS root, source AS id, 1 AS depth FROM looped WHERE target LIKE 'nation::%' UNION SELECT r.root, e.source, r.depth + 1 FROM up r JOIN looped e ON e.target = r.id WHERE r.depth < 8),
 d AS (SELECT root, id, 'downstream' AS direction, CAST(min(depth) AS INTEGER) AS depth FROM down WHERE id <> root GROUP BY 1, 2),
 found AS (SELECT * FROM d UNION ALL SELECT root, id, 'upstream', CAST(min(depth) AS INTEGER) FROM up u WHERE id <> root AND NOT EXISTS (SELECT 1 FROM d WHERE d.root = u.root AND d.id = u.id) GROUP BY 1, 2) """.replace("{graph}", GRAPH_SQL)


@plain(BOTH + "SELECT * FROM found", False)
def g_bidirectional(spark, d):
    _, edges = estate(spark, d)
    return g.bidirectional(looped(spark, d, edges), read(spark, d, "nation").selectExpr("'nation::' || n_nationkey AS id"))


@plain(f"""WITH RECURSIVE {GRAPH_SQL}, p AS (SELECT 'region::' || r_regionkey AS root, ['region::' || r_regionkey] AS path, 0 AS n FROM region
 UNION ALL SELECT root, list_append(path, e.target), n + 1 FROM p JOIN (SELECT DISTINCT source, target FROM looped) e ON e.source = path[-1] WHERE NOT list_contains(path, e.target) AND n < 3)
 SELECT root, array_to_string(path, '>') AS path FROM p WHERE n = 3 OR NOT EXISTS (SELECT 1 FROM looped e WHERE e.source = path[-1] AND NOT list_contains(path, e.target))""", False)
def g_simple_paths(spark, d):
    _, edges = estate(spark, d)
    return g.simple_paths(looped(spark, d, edges), regions(spark, d), 3).select("root", F.concat_ws(">", "path").alias("path"))


TWICE = "(SELECT * FROM assets UNION ALL SELECT id, 'later', asset_type, system, 7, seq FROM assets WHERE id LIKE 'nation::%')"


@query(f"SELECT id, name, source_rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY source_rank, seq) AS nth FROM {TWICE}) WHERE nth = 1")
def g_dedup_assets(spark, d):
    assets, _ = estate(spark, d)
    again = assets.where("id LIKE 'nation::%'").withColumns({"name": F.lit("later"), "source_rank": F.lit(7)})
    return g.dedup_assets(again.unionByName(assets)).select("id", "name", "source_rank")


@query("SELECT source, target, relationship, min(edge_seq) AS edge_seq FROM edges GROUP BY 1, 2, 3")
def g_dedup_edges(spark, d):
    _, edges = estate(spark, d)
    return g.dedup_edges(edges.withColumn("source_rank", F.lit(9)).unionByName(edges)).select("source", "target", "relationship", "edge_seq")


@query("""SELECT DISTINCT 'delta_table::gold.' || lower(name) AS source, id AS target, 'FEEDS' AS relationship FROM assets WHERE asset_type = 'table' AND source_rank = 2""")
def g_bridge(spark, d):
    assets, edges = estate(spark, d)
    delta = assets.where("asset_type = 'table' AND source_rank = 2").selectExpr("'delta_table::gold.' || lower(name) AS id", "name", "'delta_table' AS asset_type", "'delta_lake' AS system", "8 AS source_rank", "seq")
    return g.bridge_edges(assets.where("asset_type <> 'delta_table'").unionByName(delta), edges)


@query("""SELECT DISTINCT e.target AS source, e.source AS target, 'FEEDS' AS relationship FROM (SELECT source, target, 'DEPENDS_ON' AS relationship FROM edges) e JOIN assets a ON a.id = e.source JOIN assets b ON b.id = e.target
 WHERE a.asset_type IN ('column','table','measure','report') AND b.asset_type IN ('column','table','measure','report')""")
def g_reverse_feeds(spark, d):
    assets, edges = estate(spark, d)
    return g.reverse_feeds(assets, edges.withColumn("relationship", F.lit("DEPENDS_ON")))


@query("SELECT system, count(*) AS n FROM assets GROUP BY 1")
def g_assets_by_system(spark, d):
    return g.count_by(estate(spark, d)[0], "system")


@query("SELECT asset_type, count(*) AS n FROM assets GROUP BY 1")
def g_assets_by_type(spark, d):
    return g.count_by(estate(spark, d)[0], "asset_type")


@plain(f"WITH RECURSIVE {KNOTTED_SQL} SELECT id, depth AS dependency_depth FROM deep", False)
def g_depth(spark, d):
    assets, edges = estate(spark, d)
    return g.dependency_depth(assets, knotted(spark, d, edges)).select("id", "dependency_depth")


@plain(f"""WITH RECURSIVE {KNOTTED_SQL}, lead AS (SELECT node, depth, min(seq) AS seq, arg_min(id, seq) AS id FROM deep GROUP BY 1, 2),
 walk AS (SELECT 0 AS step, (SELECT node FROM lead ORDER BY depth DESC, seq LIMIT 1) AS node, (SELECT max(depth) FROM lead) AS depth
  UNION ALL SELECT w.step + 1, (SELECT l.node FROM lead l JOIN line e ON e.target = l.node WHERE e.source = w.node AND l.depth = w.depth - 1 ORDER BY l.seq LIMIT 1), w.depth - 1 FROM walk w WHERE w.depth > 0 AND w.node IS NOT NULL)
 SELECT CAST(step AS INTEGER) AS step, id FROM walk JOIN lead USING (node)""", False)
def g_critical_path(spark, d):
    assets, edges = estate(spark, d)
    return g.critical_path(assets, knotted(spark, d, edges))


@plain(f"WITH RECURSIVE {KNOTTED_SQL} SELECT id, component FROM ring", False)
def g_strong_components(spark, d):
    return g.strong_components(knotted(spark, d, estate(spark, d)[1]))


@plain(f"WITH RECURSIVE {KNOTTED_SQL} SELECT a.id, count(f.id) AS blast_radius FROM assets a LEFT JOIN far f ON f.root = a.id AND f.id <> f.root GROUP BY 1", False)
def g_blast_radius_cyclic(spark, d):
    assets, edges = estate(spark, d)
    return g.blast_radius(assets, knotted(spark, d, edges))


@query("SELECT a.id, count(f.id) AS blast_radius FROM assets a LEFT JOIN found f ON f.root = a.id GROUP BY 1", "true")
def g_blast_radius(spark, d):
    assets, edges = estate(spark, d)
    return g.blast_radius(assets, looped(spark, d, edges))


@query("SELECT a.id, count(*) AS degree FROM assets a JOIN (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) e ON e.id = a.id GROUP BY a.id, a.seq ORDER BY count(*) DESC, a.seq LIMIT 10")
def g_top_connected(spark, d):
    return g.top_connected(*estate(spark, d))


@query("SELECT id FROM assets WHERE id NOT IN (SELECT source FROM edges)")
def g_leaf(spark, d):
    return g.leaves(*estate(spark, d)).select("id")


@query("SELECT id FROM assets WHERE id NOT IN (SELECT source FROM edges) AND id NOT IN (SELECT target FROM edges)")
def g_orphan(spark, d):
    return g.orphans(*estate(spark, d)).select("id")


@plain(f"WITH RECURSIVE {KNOTTED_SQL} SELECT source, target FROM hop WHERE EXISTS (SELECT 1 FROM far WHERE root = target AND id = source)", False)
def g_cycles(spark, d):
    return g.cycle_edges(knotted(spark, d, estate(spark, d)[1]))


@query("SELECT 'target' AS \"end\", target AS id, source, target FROM edges WHERE NOT unresolved AND target NOT IN (SELECT id FROM assets) UNION ALL SELECT 'source', source, source, target FROM edges WHERE NOT unresolved AND source NOT IN (SELECT id FROM assets)")
def g_broken_refs(spark, d):
    return g.broken_references(*estate(spark, d))


def quoted(c):
    return f"chr(39) || {c} || chr(39)"


@plain(f"""WITH RECURSIVE {KNOTTED_SQL} SELECT 'cycles' AS "check", 'Cycle detected: ' || {quoted('source')} || ' → ' || {quoted('target')} AS message FROM hop WHERE EXISTS (SELECT 1 FROM far WHERE root = target AND id = source)
 UNION ALL SELECT 'broken_references', 'Broken reference: target ' || {quoted('target')} || ' does not exist (in relationship ' || {quoted('source')} || ' →)' FROM edges WHERE NOT unresolved AND target NOT IN (SELECT id FROM assets)
 UNION ALL SELECT 'dangling_assets', 'Dangling asset: ' || {quoted('id')} || ' (' || asset_type || ', ' || system || ') has no edges' FROM assets WHERE id NOT IN (SELECT source FROM knotted) AND id NOT IN (SELECT target FROM knotted)""", False)
def g_findings(spark, d):
    assets, edges = estate(spark, d)
    return g.findings(assets, knotted(spark, d, edges))


@query(f"SELECT id, count(*) AS n FROM {TWICE} GROUP BY 1 HAVING count(*) > 1")
def g_duplicate_ids(spark, d):
    assets, _ = estate(spark, d)
    return g.duplicate_ids(assets.unionByName(assets.where("id LIKE 'nation::%'")))


# The estate, and parts in chains of twenty: many components beside the large one.
CHAINS_SQL = GRAPH_SQL + """, things AS (SELECT id FROM assets UNION ALL SELECT 'part::' || p_partkey FROM part),
 ties AS (SELECT source, target FROM edges UNION ALL SELECT 'part::' || p_partkey, 'part::' || (p_partkey - 1) FROM part WHERE p_partkey % 20 <> 0),
 link AS (SELECT source AS a, target AS b FROM ties UNION SELECT target, source FROM ties),
 r(id, low) USING KEY (id) AS (SELECT id, id FROM (SELECT id FROM things UNION SELECT a FROM link) UNION SELECT b, min(r.low) FROM r JOIN link ON a = r.id JOIN recurring.r AS now ON now.id = b WHERE r.low < now.low GROUP BY b)"""


def chains(spark, d):
    assets, edges = estate(spark, d)
    parts = read(spark, d, "part")
    ties = parts.where("p_partkey % 20 <> 0").selectExpr("'part::' || p_partkey AS source", "'part::' || (p_partkey - 1) AS target")
    return assets.select("id").unionByName(parts.selectExpr("'part::' || p_partkey AS id")), edges.select("source", "target").unionByName(ties)


@plain(f"WITH RECURSIVE {CHAINS_SQL} SELECT id, low AS component FROM r", False)
def g_components(spark, d):
    return g.components(*chains(spark, d))


@plain(f"""WITH RECURSIVE {CHAINS_SQL}, n AS (SELECT low AS component, count(*) AS size, list(id ORDER BY id)[1:3] AS ids FROM r GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY size DESC, component) AS nth FROM n)
 SELECT component, size, array_to_string(ids, ',') AS sample FROM o WHERE nth > 1""", False)
def g_disconnected(spark, d):
    return g.disconnected(*chains(spark, d)).withColumn("sample", F.array_join("sample", ","))


@query("SELECT CAST(floor(avg(CASE WHEN seq % 4 = 0 THEN 1 ELSE (seq % 4) * 0.25 END) * 100 + 0.5) AS BIGINT) AS confidence FROM assets")
def g_mean_confidence(spark, d):
    assets, _ = estate(spark, d)
    return g.mean_confidence(assets.withColumn("confidence", F.when(F.col("seq") % 4 != 0, F.col("seq") % 4 * 0.25)))


@query("""SELECT asset_type AS artifact, count(*) AS n FROM assets GROUP BY 1 UNION ALL SELECT 'reports', count(*) FROM customer UNION ALL SELECT 'pages', count(*) FROM customer
 UNION ALL SELECT 'visuals', CAST(sum(c_custkey % 5) AS BIGINT) FROM customer""")
def g_artifact_counts(spark, d):
    visuals = F.when(F.col("c_custkey") % 5 > 0, F.array_repeat(F.lit("card"), (F.col("c_custkey") % 5).cast("int")))
    return g.artifact_counts(estate(spark, d)[0], read(spark, d, "customer").select(visuals.alias("visuals")))


def bucket_sql(buckets, default):
    cases = " ".join(f"WHEN asset_type IN ({', '.join(repr(t) for t in types)}) THEN '{b}'" for b, types in buckets.items() if types)
    return f"CASE {cases} ELSE {default} END"


def buckets_sql(buckets, default):
    names = ", ".join(f"('{b}')" for b in buckets)
    return f"""SELECT r.root, b.bucket, count(a.id) AS n FROM (SELECT DISTINCT root FROM found) r CROSS JOIN (VALUES {names}) b(bucket) LEFT JOIN found f ON f.root = r.root
 LEFT JOIN (SELECT id, {bucket_sql(buckets, default)} AS bucket FROM assets) a ON a.id = f.id AND a.bucket = b.bucket GROUP BY 1, 2"""


@query(buckets_sql(schemas.IMPACT_BUCKETS, "NULL"), "source LIKE 'region::%'")
def g_buckets9(spark, d):
    assets, edges = estate(spark, d)
    return g.by_bucket(g.reach(looped(spark, d, edges), regions(spark, d)), assets, schemas.IMPACT_BUCKETS)


@query(buckets_sql(schemas.ESTATE_BUCKETS, "'external_consumers'"), "source LIKE 'region::%'")
def g_buckets19(spark, d):
    assets, edges = estate(spark, d)
    return g.by_bucket(g.reach(looped(spark, d, edges), regions(spark, d)), assets, schemas.ESTATE_BUCKETS, "external_consumers")


CRITICAL_SQL = ", ".join(repr(t) for t in schemas.CRITICAL_TYPES)


@plain(BOTH + f"""SELECT root, count(*) AS total_assets, count(*) FILTER (asset_type IN ({CRITICAL_SQL})) AS critical_assets, max(depth) AS max_depth, count(DISTINCT system) AS systems_impacted,
 count(DISTINCT {bucket_sql(schemas.ESTATE_BUCKETS, "'external_consumers'")}) AS buckets_impacted, count(*) FILTER (f.id NOT IN (SELECT source FROM looped)) AS leaf_assets,
 count(*) FILTER (direction = 'upstream') AS upstream_assets, count(*) FILTER (direction = 'downstream') AS downstream_assets FROM found f JOIN assets a ON a.id = f.id GROUP BY 1""", False)
def g_impact_metrics(spark, d):
    assets, edges = estate(spark, d)
    edges = looped(spark, d, edges)
    return g.impact_metrics(g.bidirectional(edges, read(spark, d, "nation").selectExpr("'nation::' || n_nationkey AS id")), assets, edges)


@query("SELECT DISTINCT source, target FROM edges")
def g_path_edges(spark, d):
    return g.path_edges(g.simple_paths(estate(spark, d)[1], regions(spark, d), 3))


PATHS_SQL = """, p AS (SELECT ['region::' || r_regionkey] AS path, 0 AS n FROM region UNION ALL SELECT list_append(path, e.target), n + 1 FROM p JOIN (SELECT DISTINCT source, target FROM edges) e ON e.source = path[-1] WHERE NOT list_contains(path, e.target) AND n < 3)"""


@plain(f"""WITH RECURSIVE {GRAPH_SQL}{PATHS_SQL}, step AS (SELECT DISTINCT path[-1] AS id, n AS depth FROM p), far AS (SELECT source AS root, target AS id FROM edges UNION SELECT f.root, e.target FROM far f JOIN edges e ON e.source = f.id)
 SELECT id, CAST(min(depth) AS INTEGER) AS depth, coalesce(max(name), string_split(id, '::')[-1]) AS name, coalesce(max(asset_type), 'unknown') AS asset_type, max((SELECT count(*) FROM far WHERE far.root = step.id)) AS downstream FROM step LEFT JOIN assets a USING (id) GROUP BY id""", False)
def g_path_graph(spark, d):
    assets, edges = estate(spark, d)
    paths = g.simple_paths(edges, regions(spark, d), 3)
    nodes, links = g.path_graph(paths, assets.withColumn("bucket", F.lit("")))
    return nodes.join(g.downstream_counts(nodes, links), "id").select("id", "depth", "name", "asset_type", "downstream")


STAGE_SQL = " ".join(f"WHEN bucket IN ({', '.join(repr(b) for b in bs)}) THEN '{s}'" for s, bs in g.STAGES.items())


@query(f"""SELECT CASE WHEN id = 'region::0' THEN 'source' WHEN system = 'powerbi' AND bucket IN ({', '.join(repr(b) for b in g.STAGES['database'])}) THEN 'semantic' {STAGE_SQL} ELSE 'unclassified' END AS stage, asset_type, count(*) AS n
 FROM (SELECT *, {bucket_sql(schemas.ESTATE_BUCKETS, "'external_consumers'")} AS bucket FROM assets) GROUP BY 1, 2""")
def g_stages(spark, d):
    return g.stages(estate(spark, d)[0], "region::0")

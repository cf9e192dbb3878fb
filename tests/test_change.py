"""Texts and plans of change requests, warnings and metrics of a graph, and JSON rows."""

import json

from lakelineage import schemas
from lakelineage.operators import change
from lakelineage.operators import graph as g
from lakelineage.sources import estate

ASSET = "id string, name string, asset_type string, system string, seq long"
ASSETS = [
    ("table::sales", "sales", "table", "powerbi", 0), ("notebook::b", "nb_b", "notebook", "databricks", 1), ("notebook::a", "nb_a", "notebook", "databricks", 2), ("notebook::c", "nb_c", "notebook", "databricks", 3),
    ("notebook::d", "nb_d", "notebook", "databricks", 4), ("view::v", "v", "view", "sql", 5), ("report::r", "r", "report", "powerbi", 6), ("table::alone", "lonely", "table", "sql", 7),
]
EDGE = "source string, target string, relationship string, source_rank int, edge_seq long"
EDGES = [("table::sales", "view::v", "FEEDS", 0, 0), ("view::v", "report::r", "FEEDS", 0, 1)] + [("table::sales", f"notebook::{x}", "FEEDS", 0, 2 + i) for i, x in enumerate("abcd")]


def analyzed(spark, *texts):
    requests = spark.createDataFrame(list(enumerate(texts)), "request_id int, request string")
    found = change.analyze(requests, spark.createDataFrame(ASSETS, ASSET), spark.createDataFrame(EDGES, EDGE))
    return {r.request_id: r for r in found["summaries"].collect()}


def test_summaries_and_plans(spark):
    got = analyzed(spark, "Drop the sales table", "Rename lonely table to solo", "Delete NonExistentColumn column")
    one = got[0]
    assert one.executive_summary == "Table Delete on 'sales' (table, powerbi). Downstream impact: 4 databricks notebooks, 1 sql views, 1 powerbi reports."
    assert one.deployment_plan == [
        "1. Apply table_delete to 'sales' (powerbi).", "2. Update all affected SQL views, procedures, and functions.", "3. Update Databricks notebooks: nb_a, nb_b, nb_c.", "4. Republish and validate Power BI reports.", "5. Run end-to-end regression tests.",
    ]
    assert one.validation_checklist == ["Verify source asset change applied successfully.", "Confirm all SQL views return correct results.", "Re-run Databricks notebooks and check output tables.", "Open Power BI reports and confirm visuals render correctly.", "Run automated regression test suite."]
    assert one.rollback_plan == [
        "1. Revert Power BI reports to last published version.", "2. Revert Databricks notebooks to previous version.", "3. Restore previous SQL view/procedure/function definitions.", "4. Revert table_delete on 'sales'.", "5. Validate rollback by running regression tests.",
    ]
    assert one.summary == "Change type : TABLE_DELETE\nSource asset: table::sales (table, powerbi)\nTotal impact: 6 downstream assets\nBreakdown   : 1 SQL asset, 4 Databricks assets, 1 Power BI asset"
    two = got[1]
    assert two.executive_summary == "Table Rename (lonely → solo) on 'lonely' (table, sql). No downstream assets are impacted by this change."
    assert two.summary.endswith("Total impact: 0 downstream assets\nBreakdown   : no downstream assets identified") and two.summary.startswith("Change type : TABLE_RENAME (lonely -> solo)\n")
    three = got[2]
    assert three.executive_summary == "No enterprise asset named 'NonExistentColumn' was found in the metadata graph. No impact analysis could be performed."
    assert three.deployment_plan == ["Resolve the source asset before planning deployment."] and three.rollback_plan == ["No rollback required (source asset was not resolved)."]
    assert "searched for 'NonExistentColumn'" in three.summary and "All impact metrics are zero." in three.summary


def test_findings_and_metrics(spark):
    assets = spark.createDataFrame([*ASSETS, ASSETS[0]], ASSET)
    edges = spark.createDataFrame([*EDGES, ("report::r", "table::sales", "FEEDS", 0, 8), ("view::v", "gone", "READS", 0, 9)], EDGE)
    found = g.findings(assets, edges)
    said = {}
    for r in found.collect():
        said.setdefault(r.check, set()).add(r.message)
    assert said["dangling_assets"] == {"Dangling asset: 'table::alone' (table, sql) has no edges"} and said["duplicate_ids"] == {"Duplicate asset id: 'table::sales'"}
    assert said["broken_references"] == {"Broken reference: target 'gone' does not exist (in relationship 'view::v' →)"} and len(said["cycles"]) == 3
    assert said["disconnected_subgraphs"] == {"Disconnected subgraph: 1 assets, such as table::alone"}
    assert tuple(g.findings_summary(found).first()) == (True, "cycles=3, broken_refs=1, duplicates=1, dangling=1, disconnected_subgraphs=1")
    clean = g.findings(spark.createDataFrame(ASSETS[:2], ASSET), spark.createDataFrame([("table::sales", "notebook::b", "FEEDS", 0, 0)], EDGE))
    assert tuple(g.findings_summary(clean).first()) == (False, "cycles=0, broken_refs=0, duplicates=0, dangling=0, disconnected_subgraphs=0")
    every = g.metrics(spark.createDataFrame(ASSETS, ASSET), spark.createDataFrame(EDGES, EDGE))
    assert tuple(every["totals"].first()) == (8, 6) and {tuple(r) for r in every["blast_radius"].where("blast_radius > 0").collect()} == {("table::sales", 6), ("view::v", 1)}
    assert len(every) == 9 and [r.id for r in every["orphan_assets"].collect()] == ["table::alone"]


def test_registry_keeps_repeated_edges(spark):
    source = lambda: (spark.createDataFrame(ASSETS, ASSET), spark.createDataFrame(EDGES, EDGE))
    bad = lambda: (spark.createDataFrame(ASSETS, ASSET).selectExpr("*", "1 / 0 AS x").where("x > 0"), source()[1])
    assets, edges, failed = estate.load({"one": source, "bad": bad, "two": source}, registry=True)
    assert assets.count() == len(ASSETS) and edges.count() == 2 * len(EDGES) and set(failed) == {"bad"}


def test_json_rows(spark):
    rows = spark.createDataFrame([(1, None, ["x"], {"k": "v"})], "i int, s string, a array<string>, m map<string,string>")
    assert json.loads(schemas.as_json(rows).first().json) == {"i": 1, "s": None, "a": ["x"], "m": {"k": "v"}}


def test_path_graph(spark):
    paths = spark.createDataFrame([(["t::a", "table::LocalDateTable_1", "m::b", "r::c"],), (["t::a", "r::c"],), (["r::c"],)], "path array<string>")
    found = spark.createDataFrame([("m::b", "B", "measure", "powerbi", "semantic_models"), ("x::y", "Y", "view", "sql", "views"), ("table::DateTableTemplate_2", "D", "table", "powerbi", "database_tables")], "id string, name string, asset_type string, system string, bucket string")
    nodes, edges = g.path_graph(paths, found, "t::a")
    assert {tuple(r) for r in nodes.collect()} == {("t::a", 0, "a", "unknown", "unknown", ""), ("m::b", 1, "B", "measure", "powerbi", "semantic_models"), ("r::c", 0, "c", "unknown", "unknown", ""), ("x::y", 1, "Y", "view", "sql", "views")}
    assert {tuple(r) for r in edges.collect()} == {("t::a", "m::b"), ("m::b", "r::c"), ("t::a", "r::c")}
    assert {tuple(r) for r in g.downstream_counts(nodes, edges).collect()} == {("t::a", 2), ("m::b", 1), ("r::c", 0), ("x::y", 0)}

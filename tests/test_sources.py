"""Sources, merging and text functions on small inputs with known results."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from lakelineage.functions import text
from lakelineage.operators import graph
from lakelineage.sources import estate, notebooks, semantic_model, sql_ddl


@pytest.fixture
def model(tmp_path):
    tables = tmp_path / "m.SemanticModel" / "definition" / "tables"
    tables.mkdir(parents=True)
    (tables / "sales.tmdl").write_text("table sales\n\tlineageTag: s\n\n\tcolumn Amount\n\t\tdataType: int64\n\t\tlineageTag: a\n\n\thierarchy H\n\t\tlineageTag: h\n\t\tlevel L\n\t\t\tlineageTag: l\n\n\tpartition p = m\n\t\tmode: import\n")
    (tables / "_Measures.tmdl").write_text("table _Measures\n\tmeasure Total = SUM(sales[Amount])\n\t\tlineageTag: t\n\n\tmeasure 'Half of it' =\n\t\t\t[Total]\n\t\t\t/ 2\n\t\tformatString: 0\n")
    (tables / "LocalDateTable_1.tmdl").write_text("table LocalDateTable_1\n\tcolumn Date\n\t\tlineageTag: d\n\t\tlineageTag: e\n")
    (tables.parent / "relationships.tmdl").write_text("relationship r1\n\tisActive: false\n\tjoinOnDateBehavior: datePartOnly\n\tfromColumn: sales.Date\n\ttoColumn: LocalDateTable_1.Date\n")
    page = tmp_path / "m.Report" / "definition" / "pages" / "p1"
    (page / "visuals" / "v").mkdir(parents=True)
    (page.parent / "pages.json").write_text(json.dumps({"pageOrder": ["p1", "gone"]}))
    (page / "page.json").write_text(json.dumps({"name": "p1", "displayName": "One"}))
    field = {"Measure": {"Expression": {"SourceRef": {"Entity": "_Measures"}}, "Property": "Total"}}
    (page / "visuals" / "v" / "visual.json").write_text(json.dumps({"visual": {"visualType": "card", "query": {"queryState": {"Values": {"projections": [{"field": field}]}}}}}))
    return str(tmp_path / "m.SemanticModel"), str(tmp_path / "m.Report")


def test_model_with_hidden_file_and_internal_table(spark, model):
    found = semantic_model.load_model(spark, *model)
    rows = {(r.table, r.kind, r.name): r for r in found["objects"].collect()}
    assert set(rows) == {("sales", "table", "sales"), ("sales", "column", "Amount"), ("sales", "partition", "p"), ("_Measures", "table", "_Measures"), ("_Measures", "measure", "Total"), ("_Measures", "measure", "Half of it")}
    assert rows["_Measures", "measure", "Half of it"].expression == "[Total]\n/ 2" and rows["sales", "column", "Amount"].props == {"dataType": "int64", "lineageTag": "a"}
    every = semantic_model.load_model(spark, *model, include_internal=True)["objects"]
    assert every.where("table = 'LocalDateTable_1' AND kind = 'column'").first().props == {"lineageTag": "d"}
    rel = found["relationships"].first()
    assert (rel.is_active, rel.join_on_date, rel.to_cardinality, rel.from_cardinality) == (False, "datePartOnly", None, "many")
    views = semantic_model.payload(found)
    assert set(views) == {"tables", "columns", "measures", "relationships", "reports", "dependencies"} and {"name", "source_type", "is_date_table", "lineage_tag"} <= set(views["tables"].columns)
    assert {(r.name, r.source_type) for r in views["tables"].collect()} >= {("sales", "m")} and {(r.table_name, r.name, r.data_type) for r in views["columns"].collect()} >= {("sales", "Amount", "int64")}
    shown = semantic_model.annotated_reports(found["pages"], found["fields"]).collect()
    assert [(r.page, r.used_measures, r.used_columns, r.used_tables) for r in shown] == [("p1", ["Total"], [], ["_Measures"])]
    measures = {r.name: r for r in semantic_model.annotated_measures(found["objects"]).collect()}
    assert measures["Total"].referenced_columns == ["sales[Amount]"] and measures["Half of it"].referenced_measures == ["Total"]
    assets, edges = semantic_model.model_graph(found["objects"], found["dependencies"], found["relationships"].limit(0), found["pages"])
    ids = {r.id for r in assets.collect()}
    assert "report::p1" in ids and all(r.source in ids and r.target in ids for r in edges.collect())


def test_workflow_graph(spark):
    yml = "pipeline:\n  name: p\n  tasks:\n    - name: a\n      notebook: /x/nb/\n    - name: b\n      depends_on: [a]\n    - name: c\n      depends_on: abc\n"
    assets, edges = estate.workflow_graph(estate.workflow_tasks(spark.createDataFrame([("f", yml), ("g", "a: ["), ("h", None)], "file string, text string")))
    assert {r.id for r in assets.collect()} == {"pipeline::p", "pipeline_task::p::a", "pipeline_task::p::b", "pipeline_task::p::c", "notebook::nb"}
    tasks = {("pipeline::p", f"pipeline_task::p::{t}", "TRIGGERS") for t in "abc"}
    assert {tuple(r) for r in edges.collect()} == tasks | {("pipeline_task::p::a", "pipeline_task::p::b", "TRIGGERS"), ("pipeline_task::p::a", "notebook::nb", "CALLS")}


def test_load_keeps_the_first_and_leaves_out_what_fails_on_read(spark, tmp_path):
    def source(*ids):
        a = spark.createDataFrame([(i, f"{i} of {ids[0]}", "table", "database") for i in ids], "id string, name string, asset_type string, system string")
        return a, spark.createDataFrame([(ids[0], ids[-1], "FEEDS")], "source string, target string, relationship string")

    def late():
        a, e = source("x", "y")
        return a.withColumn("name", F.raise_error(F.lit("no")).cast("string")), e

    def early():
        raise OSError("gone")

    assets, edges, failed = estate.load({"one": lambda: source("a", "b"), "late": late, "early": early, "two": lambda: source("c", "b", "a")})
    assert {r.id: r.name for r in assets.collect()} == {"a": "a of a", "b": "b of a", "c": "c of c"}
    assert set(failed) == {"late", "early"} and edges.where("relationship = 'FEEDS'").count() == 2


def test_responses():
    assert json.loads(text.json_of('so {"a": {"b": [1, 2,],},} end')) == {"a": {"b": [1, 2]}}
    assert json.loads(text.json_of('{x} ```json\n{"a": "}"}\n```')) == {"a": "}"}
    assert text.json_of("no {json") is None and text.json_of(None) is None


def test_response_defaults(spark):
    rows = spark.createDataFrame([(1, "nothing"), (2, '{"risk_level": "HIGH", "deployment_plan": ["x"]}'), (3, "{}")], "k int, response string")
    got = {r.k: r for r in text.responses(rows).collect()}
    assert (got[1].risk_level, got[1].executive_summary) == ("critical", "[PARSE ERROR] Could not parse LLM response.") and "manual review" in got[1].risk_rationale
    assert (got[2].risk_level, got[2].risk_rationale, got[2].deployment_plan) == ("high", "", ["x"]) and got[3].risk_level == "unknown"


def test_keywords_and_table_point(spark):
    row = spark.range(1).select(text.keywords(F.lit("Please rename sales_dashboard[Revenue] to 'Gross/Net', of the KPI")).alias("k")).first()
    assert row.k == ["please", "sales_dashboard", "revenue", "gross", "net", "kpi"]
    items = spark.createDataFrame([("column", "t1", "a", 0), ("column", "t2", "b", 0), ("measure", "t1", "c", 0)], "kind string, table string, name string, score int")
    got = {r.name: r.score for r in text.with_table_point(items, spark.createDataFrame([("t1",), ("t1",)], "name string")).collect()}
    assert got == {"a": 1, "b": 0, "c": 0}


def test_split_script():
    assert sql_ddl.split_script("a; CREATE PROC p AS BEGIN x; BEGIN y; END; END; b;; END; c") == ["a", "CREATE PROC p AS BEGIN x; BEGIN y; END; END", "b", "END", "c"]
    assert sql_ddl.split_script("a; b\n go \nc") == ["a; b", "c"] and sql_ddl.split_script("") == []


def test_split_many_scripts():
    script = "CREATE TABLE t (a INT); CREATE PROCEDURE p AS BEGIN SELECT 1; SELECT 2; END; beginning; END; ends"
    began = time.process_time()
    for _ in range(3000):
        assert len(sql_ddl.split_script(script)) == 5
    assert time.process_time() - began < 1  # a table per script took 2 ms or more


def test_reach_in_order_and_without(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}", i) for i in range(90)]
    df = spark.createDataFrame(edges, "source string, target string, edge_seq long")
    roots = spark.createDataFrame([("n1",), ("n2",)], "id string")
    got = sorted(graph.reach(df, roots, ordered=True).collect(), key=lambda r: (r.root, r.depth, r.pos))
    for root in ("n1", "n2"):
        seen, line = {root: 0}, [root]
        for x in line:
            for s, t, _ in edges:
                if s == x and t not in seen:
                    seen[t] = seen[x] + 1
                    line.append(t)
        assert [(r.id, r.depth) for r in got if r.root == root] == [(x, seen[x]) for x in line[1:]]
    plain = graph.reach(df, roots)
    assert plain.columns == ["root", "id", "depth"] and {tuple(r) for r in plain.collect()} == {(r.root, r.id, r.depth) for r in got}


def test_header_graph_with_stub_tables(spark):
    found = spark.createDataFrame([("/x/a.py", "load", ["b.t", "b.u"], ["s.t"]), ("/x/c.py", None, ["s.t"], [])], "file string, notebook_name string, read_tables array<string>, write_tables array<string>")
    assets, edges = notebooks.header_graph(found)
    assert {tuple(r) for r in assets.collect()} == {
        ("notebook::load", "load", "databricks_notebook", "databricks"), ("notebook::c.py", "c.py", "databricks_notebook", "databricks"),
        ("delta_table::b.t", "t", "delta_table", "delta_lake"), ("delta_table::b.u", "u", "delta_table", "delta_lake"), ("delta_table::s.t", "t", "delta_table", "delta_lake"),
    }
    assert {tuple(r) for r in edges.collect()} == {("delta_table::b.t", "notebook::load", "READS"), ("delta_table::b.u", "notebook::load", "READS"), ("delta_table::s.t", "notebook::c.py", "READS"), ("notebook::load", "delta_table::s.t", "WRITES")}
    assert notebooks.header_graph(found, stubs=False)[0].count() == 2


def test_order_of_scripts(spark):
    files_ = spark.createDataFrame([(f,) for f in ("/d/a.sql", "/d/functions.sql", "/d/Tables.sql", "/d/procedures.sql", "/d/views.sql", "/d/B.sql")], "file string")
    assert [r.file[3:] for r in files_.orderBy(sql_ddl.file_order(F.col("file"))).collect()] == ["Tables.sql", "views.sql", "procedures.sql", "functions.sql", "a.sql", "B.sql"]


def test_owners_of_a_source(spark):
    rows = spark.createDataFrame([("a", "", "medium"), ("b", "me", "high")], "id string, owner string, criticality string")
    assert [tuple(r) for r in estate.owned(rows, "powerbi", "team", "low").orderBy("id").collect()] == [("a", "team", "low", "powerbi"), ("b", "me", "high", "powerbi")]
    assert tuple(estate.owned(rows.select("id"), "api").where("id = 'a'").first()) == ("a", None, "medium", "api")


def test_source_scan_helpers(spark):
    rows = spark.createDataFrame([("/a/02_load.py", [("code", "x = 1"), ("markdown", "no"), ("CODE", "y = 2")])], "path string, cells array<struct<cell_type:string,source:string>>")
    assert tuple(rows.select(notebooks.execution_order(F.col("path")), notebooks.code_of(F.col("cells"))).first()) == (2, "x = 1\ny = 2")
    edges = notebooks.source_edges(spark.createDataFrame([("/n", 'spark.table("a.b"); df.write.saveAsTable("c.d")')], "path string, source string"))
    assert {tuple(r) for r in edges.collect()} == {("notebook::/n", "delta_table::a.b", "READS"), ("notebook::/n", "delta_table::c.d", "WRITES")}


def test_names_folders_and_schemas_of_notebooks(spark):
    rows = spark.createDataFrame([(1, "n", "/x/y.py", "", ["c.s.t", "s.u", "bare", "c.r.t"]), (2, "", "/x/Load.IPYNB/", None, []), (3, None, "alone.sql", "/w", ["/delta/a"]), (4, None, "/top", None, None)], "i int, name string, path string, folder string, tables array<string>")
    catalogs, schemas_ = notebooks.catalogs_and_schemas(F.coalesce("tables", F.array().cast("array<string>")))
    got = rows.orderBy("i").select(notebooks.notebook_name(F.col("name"), F.col("path")), notebooks.workspace_folder(F.col("folder"), F.col("path")), catalogs, schemas_).collect()
    assert [tuple(r) for r in got] == [("n", "/x", ["c"], ["c.r", "c.s", "s"]), ("Load", "/x", [], []), ("alone", "/w", [], []), ("top", "/", [], [])]

"""Snapshots and prompts for a few requests by hand; responses and scrubbing by bucket; inventory headers."""

import json

from lakelineage.functions import text
from lakelineage.operators import snapshot
from lakelineage.sources import estate

REQUEST = "request_id long, request string"


def model(spark):
    make = spark.createDataFrame
    return snapshot.snapshot({
        "table": make([(0, "sales", "import", None), (1, "customer", None, "buyers"), (2, None, None, None)], "seq long, name string, source_type string, description string"),
        "column": make([(0, "sales", "Revenue", "double"), (1, "sales", "Id", None), (2, "customer", "Id", "int"), (3, "gone", "Revenue", "int")], "seq long, table_name string, name string, data_type string"),
        "measure": make([(0, "M", "Total", "SUM(sales[Revenue])\n" + "x" * 100, ["sales"]), (1, "M", "Other", None, None)], "seq long, table_name string, name string, expression string, referenced_tables array<string>"),
        "relationship": make([(0, "a", "x", "b", "y"), (1, "sales", "c", "customer", "id"), (2, "customer", "g", "customer", "g")], "seq long, from_table string, from_column string, to_table string, to_column string"),
        "report": make([(0, "p0", None, ["None"], None), (1, "p1", "Page", ["Total"], ["customer"]), (2, "p2", "Two", None, ["sales"])], "seq long, page_name string, display_name string, used_measures array<string>, used_tables array<string>"),
    })


def test_relevant_artifacts(spark):
    asked = spark.createDataFrame([(1, "Drop Revenue of SALES"), (2, "nothing fits"), (3, None)], REQUEST)
    got = {}
    for r in snapshot.relevant(asked, model(spark)).orderBy("place").collect():
        got.setdefault((r.request_id, r.kind), []).append(r.seq)
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, "table"): [0], (1, "measure"): [0], (1, "column"): [0, 1, 3], (1, "relationship"): [1], (1, "report"): [1, 2]}
    for i in (2, 3):  # no keyword is found: the first ones by name
        assert got[i, "table"] == [2, 1, 0] and got[i, "measure"] == [1, 0] and got[i, "report"] == [1, 2] and got[i, "relationship"] == [1, 2]
        assert got[i, "column"] == [1, 2, 0]  # columns of tables that count have a point


def test_prompts(spark):
    asked = spark.createDataFrame([(1, "Drop Revenue of SALES")], REQUEST)
    shot = model(spark)
    lines = snapshot.shown(snapshot.relevant(asked, shot), shot)
    prompt = snapshot.prompts(asked, lines).first()
    assert "Drop Revenue of SALES" in prompt.prompt and "TABLES:\nsales\n" in prompt.prompt and "sales[c]->customer[id]" in prompt.prompt and "sales.Revenue:double\nsales.Id:?" in prompt.prompt
    shown = next(x for x in prompt.prompt.split("\n") if x.startswith("[Total]"))
    assert shown.endswith("…") and len(shown) == len("[Total] = ") + 81
    assert prompt.tokens == int(len(prompt.prompt.split()) * 1.3) and not prompt.over_budget
    assert snapshot.within_budget(lines, 2).count() == 2 and snapshot.within_budget(lines, 10**6).count() == lines.count()


def test_prompts_from_the_graph(spark):
    asked = spark.createDataFrame([(1, "Drop it"), (2, "none")], REQUEST)
    counts = spark.createDataFrame([(1, "views", 2), (1, "dashboards", 0), (1, "apis", 0), (2, "views", 0), (2, "dashboards", 0), (2, "apis", 0)], "request_id long, bucket string, n long")
    names = spark.createDataFrame([(1, "views", "v2"), (1, "views", "v1")], "request_id long, bucket string, name string")
    got = {r.request_id: r for r in snapshot.graph_prompts(asked, counts, names).collect()}
    assert "  views (2): v1, v2" in got[1].prompt and got[1].absent == ["dashboards", "apis"]
    assert "dashboards: EMPTY" in got[1].prompt and "Do NOT mention apis" in got[1].prompt and "views: EMPTY" not in got[1].prompt
    assert "  (none)" in got[2].prompt and got[2].absent == ["views", "dashboards", "apis"]


def test_responses_with_texts_for_lists(spark):
    given = [json.dumps({"executive_summary": "s", "risk_level": "HIGH", "deployment_plan": "do it all", "validation_checklist": " ", "rollback_plan": ["a", "b"]}), '{"deployment_plan": 3, "rollback_plan": null,}', "no json", None]
    rows = text.responses(spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, response string")).orderBy("i").collect()
    assert (rows[0].deployment_plan, rows[0].validation_checklist, rows[0].rollback_plan, rows[0].risk_level) == (["do it all"], [], ["a", "b"], "high")
    assert (rows[1].deployment_plan, rows[1].rollback_plan) == ([], []) and rows[2].risk_level == "critical" == rows[3].risk_level


def test_scrubbing_by_bucket(spark):
    rows = [(1, ["Update the Notebook", "Move table"], ["Check the SQL View"], None, ["databricks_notebooks", "views"]), (2, ["Review the dashboard"], [], ["undo the DAG run"], ["airflow", "unknown"]), (3, ["notebook"], None, None, None)]
    found = text.scrubbed(spark.createDataFrame(rows, "i int, deployment_plan array<string>, validation_checklist array<string>, rollback_plan array<string>, empty_buckets array<string>")).orderBy("i").collect()
    assert [(r.deployment_plan, r.validation_checklist, r.rollback_plan, r.removed) for r in found] == [(["Move table"], [], [], ["Update the Notebook", "Check the SQL View"]), (["Review the dashboard"], [], [], ["undo the DAG run"]), (["notebook"], [], [], [])]


def test_inventory_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("File_Name, CONTAINER ,folder,Target_Table,more\nx.parquet,c,/f/,bronze.x,1\n ,c,f,t,2\n")
    assert [tuple(r) for r in estate.inventory(spark, str(tmp_path / "a.csv")).collect()] == [("x.parquet", "c", "/f/", None, None, "bronze.x")]
    (tmp_path / "b.csv").write_text("filename,bronze_table,target\ny,old,new\n")
    assert [(r.file_name, r.target) for r in estate.inventory(spark, str(tmp_path / "b.csv")).collect()] == [("y", "new")]


def test_columns_with_the_same_keywords_are_one_class(spark):
    keys = spark.createDataFrame([(["gear"], "gear"), (["gear", "small"], "gear"), (["gear", "small"], "small")], "_ask array<string>, q string")
    rows = spark.range(400).selectExpr("id AS seq", "'t' || id % 2 AS table_name", "CASE id % 4 WHEN 0 THEN 'small ' ELSE '' END || 'gear ' || lpad(id, 4, '0') AS name")
    words, first = snapshot._classes(keys, rows, "column", 10, spark.createDataFrame([("t0",)], "_table string"))
    got = sorted((tuple(r["class"]["_held"]), r["_table"] or "", r["seq"]) for r in first.collect())
    want = [(("gear",), "", i) for i in range(1, 21, 2)] + [(("gear",), "t0", i) for i in range(2, 42, 4)] + [(("gear", "small"), "t0", i) for i in range(0, 40, 4)]
    assert got == sorted(want) and words.count() == 4


def test_requests_with_the_same_keywords(spark):
    asked = spark.createDataFrame([(i, ["Drop Revenue of SALES", "of sales: revenue", "nothing"][i % 3]) for i in range(30)], REQUEST)
    got = {}
    for r in snapshot.relevant(asked, model(spark)).collect():
        got.setdefault(r.request_id, set()).add((r.kind, r.seq, r.place))
    assert len(got) == 30 and all(got[i] == got[i % 3] for i in got) and {x for k, x, _ in got[0] if k == "column"} == {0, 1, 3}

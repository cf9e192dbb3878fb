"""Requests to assets: all four tiers against a plain search, and the contained and close names against all pairs."""

import difflib
import random
import re

import pytest

from lakelineage.functions import lineage
from lakelineage.operators import change, resolver

ASSET = "id string, name string, asset_type string, system string, seq long, properties map<string,string>"
REQUEST = "request_id long, target_name string, table_name string, system string, change_type string"
TYPES = {"TABLE": ("table", "database_table"), "COLUMN": ("column", "database_column")}


def plain(x):
    return re.sub(r"[\s_\-]+", "", x or "").lower()


def search(request, assets):
    """One request against a list of assets, tier by tier."""
    _, target, table, system, kind = request
    q, hint = plain(target), plain(table)
    if not q:
        return None, None
    types = TYPES.get((kind or "").split("_")[0], ())
    assets = [a for a in assets if plain(a[1])]
    same = [a for a in assets if plain(a[1]) == q]
    place = lambda a: {plain(x) for x in (a[0].split("::")[-2:-1] if a[0].count("::") > 1 else []) + ([a[5]["table_name"]] if a[5] and "table_name" in a[5] else [])}
    tiers = [(1, [a for a in same if hint and hint in place(a)]), (2, [a for a in same if hint and hint in plain(a[0])]), (2, same), (3, [a for a in assets if q in plain(a[1]) or plain(a[1]) in q])]
    near = difflib.get_close_matches(q, list(dict.fromkeys(plain(a[1]) for a in assets)), n=5, cutoff=0.6)
    tiers.append((4, [a for name in near for a in assets if plain(a[1]) == name]))
    for tier, found in tiers:
        if found:
            for ok in (lambda a: a[3] == system and a[2] in types, lambda a: a[2] in types, lambda a: a[3] == system):
                if best := next((a for a in found if ok(a)), None):
                    return best[0], tier
            return found[0][0], tier
    return None, None


def made(rng):
    words = ["sales", "order", "Revenue", "customer", "cust", "id", "total", "date", "Key", "x", "net", "gross", "ümlaut"]
    assets = []
    for i in range(160):
        name = rng.choice(["_", " ", "-", ""]).join(rng.choices(words, k=rng.randrange(1, 4)))
        if i % 7 == 0:
            name = name[: rng.randrange(len(name) + 1)] + rng.choice("abcxyz")
        kind = rng.choice(["column", "table", "measure", "database_column", "database_table", "database"])
        table = rng.choice(["sales", "my_sales", "Customer 360"])
        assets.append((f"{kind}::{table}::{name}" if i % 3 else f"{kind}::{name}", name if i % 31 else rng.choice(["", "__", None]), kind, rng.choice(["powerbi", "sql", "database"]), i, {"table_name": table} if i % 5 == 0 else None))
    requests = []
    for i in range(220):
        target = rng.choice(["_", " ", ""]).join(rng.choices(words, k=rng.randrange(1, 4)))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(target) + 1)
            target = target[:at] + rng.choice("aeiouxyz") + target[at + rng.randrange(2) :]
        target = {3: None, 4: "", 5: "_ -"}.get(i, target)
        requests.append((i, target, rng.choice([None, None, "", "sales", "customer_360", "my sales", "sal"]), rng.choice([None, "sql", "powerbi"]), rng.choice(["COLUMN_DELETE", "TABLE_RENAME", "UNKNOWN", "COLUMN_ADD"])))
    return assets, requests


def test_all_tiers_against_a_plain_search(spark):
    assets, requests = made(random.Random(6))
    got = resolver.resolve(spark.createDataFrame(requests, REQUEST), spark.createDataFrame(assets, ASSET)).collect()
    want = {r[0]: search(r, assets) for r in requests}
    assert {r.request_id: (r.asset_id, r.tier) for r in got} == want
    assert len(got) == len(requests) and {t for _, t in want.values()} == {None, 1, 2, 3, 4}


def test_contained_and_close_against_all_pairs(spark):
    rng = random.Random(7)
    texts = lambda n: sorted({"".join(rng.choices("abcd", k=rng.randrange(1, 12))) for _ in range(n)})
    qs, names = texts(60), texts(200)
    q, n = spark.createDataFrame([(x,) for x in qs], "q string"), spark.createDataFrame([(x,) for x in names], "name string")
    assert {tuple(r) for r in resolver.contained(q, n).collect()} == {(a, b) for a in qs for b in names if a in b or b in a}
    every = {(a, b) for a in qs for b in names if difflib.SequenceMatcher(None, b, a).ratio() >= 0.6}
    assert {(r.q, r.name) for r in resolver.close(q, n, kept=10**6).collect()} == every
    five = {(a, b, k) for a in qs for k, b in enumerate(difflib.get_close_matches(a, names, n=5, cutoff=0.6), 1)}
    assert {tuple(r) for r in resolver.close(q, n).collect()} == five


def test_no_nested_loops_in_plans(spark):
    q, n = spark.createDataFrame([("abc",)], "q string"), spark.createDataFrame([("abd",)], "name string")
    for df in (resolver.contained(q, n), resolver.close(q, n)):
        assert not re.search("NestedLoop|Cartesian", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("text, asset", [("Drop the amount column from sales", "column::sales::amount"), ("Drop the orders table", "database_table::orders"), ("Delete CustomerIdd", "column::c::CustomerID"), ("hello", None)])
def test_requests_as_text(spark, text, asset):
    rows = [("column::my_sales::amount", "amount", "column", "powerbi", 0, None), ("column::sales::amount", "amount", "column", "powerbi", 1, None), ("database::orders", "orders", "database", "database", 2, None), ("database_table::orders", "orders", "database_table", "database", 3, None), ("column::c::CustomerID", "CustomerID", "column", "powerbi", 4, None)]
    asked = change.parse(spark.createDataFrame([(1, text)], "request_id long, request string"))
    assert change.resolve(asked, spark.createDataFrame(rows, ASSET)).first().asset_id == asset


def test_nothing_to_resolve(spark):
    assets, requests = spark.createDataFrame([], ASSET), spark.createDataFrame([(1, "a", None, None, "UNKNOWN")], REQUEST)
    assert [tuple(r)[-3:] for r in resolver.resolve(requests, assets).collect()] == [(None, None, None)]
    assert resolver.resolve(requests.limit(0), assets).count() == 0


def test_large_sides_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lineage, "FEW", -1)  # as if every side were large
    q, n = spark.createDataFrame([("abc",)], "q string"), spark.createDataFrame([("abd",), ("xabcx",)], "name string")
    for df in (resolver.contained(q, n), resolver.close(q, n)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert [tuple(r) for r in resolver.contained(q, n).collect()] == [("abc", "xabcx")]
    assert sorted(tuple(r) for r in resolver.close(q, n).collect()) == [("abc", "abd", 2), ("abc", "xabcx", 1)]


def test_names_of_one_shape_are_one_entry(spark):
    q = spark.createDataFrame([("small ring",), ("rder7",)], "q string")
    names = [f"order{i}" for i in range(300)] + ["smalll ring", "ring small"]
    got = {(r.q, r.name, r.place) for r in resolver.close(q, spark.createDataFrame([(x,) for x in names], "name string")).collect()}
    assert got == {(a, b, k) for a in ("small ring", "rder7") for k, b in enumerate(difflib.get_close_matches(a, names, n=5, cutoff=0.6), 1)}

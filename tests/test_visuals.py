"""Visuals over small tables: groups along relationships, blanks, values that groups don't filter, and what isn't supported."""

import datetime as dt

import pytest

from lakelineage.plans import visuals as v
from lakelineage.queries import report
from lakelineage.sources import semantic_model


@pytest.fixture(scope="module")
def model(spark):
    day = dt.date
    sales = [
        ("o1", 1, 10, day(2024, 1, 31), "North", 5.0, 1.0), ("o2", 1, 11, day(2024, 2, 1), "North", 7.0, 2.0), ("o3", 2, 10, day(2024, 3, 1), "South", 11.0, 3.0), ("o4", 9, 10, day(2023, 2, 1), None, 13.0, 4.0),
    ]
    fact = spark.createDataFrame(sales, "OrderNumber string, CustomerID int, ProductID int, OrderDate date, Region string, Revenue double, Profit double")
    people = spark.createDataFrame([(1, "N", "gold"), (2, "S", None), (3, "N", "gold")], "CustomerID int, Zone string, Kind string")
    zones = spark.createDataFrame([("N", "here", 2), ("N", "there", 3), ("S", "here", 4), ("X", "far", 5)], "Zone string, Land string, Size int")
    plans = spark.createDataFrame([("here", 100)], "Land string, Goal int")
    links = (v.Relationship("sales_dashboard", "CustomerID", "people", "CustomerID"), v.Relationship("people", "Zone", "zones", "Zone"), v.Relationship("zones", "Land", "plans", "Land", both=True), v.Relationship("sales_dashboard", "ProductID", "zones", "Size", is_active=False))
    return v.Model({"sales_dashboard": fact, "people": people, "zones": zones, "plans": plans}, links, frozenset({("zones", "Size"), ("plans", "Goal")}))


def rows(model, *fields):
    made = [v.Field(role, *(("_Measures", name[1:-1], True) if name.startswith("[") else (*name.split("."), False))) for role, name in fields]
    return sorted((tuple(r) for r in v.compile_visual(model, made).collect()), key=repr)


def test_paths(model):
    assert v.path(model, "zones", "sales_dashboard") == [("Zone", "people", "Zone"), ("CustomerID", "sales_dashboard", "CustomerID")]
    assert v.path(model, "plans", "sales_dashboard") == [("Land", "zones", "Land"), ("Zone", "people", "Zone"), ("CustomerID", "sales_dashboard", "CustomerID")]
    assert v.path(model, "zones", "plans") == [("Land", "plans", "Land")]
    assert v.path(model, "sales_dashboard", "people") is None and v.path(model, "people", "people") == []


def test_groups_filter_along_relationships(model):
    assert rows(model, ("Category", "people.Kind"), ("Y", "[Total Revenue]")) == [("gold", 12.0), (None, 24.0)]
    # Both rows of zone N lead to the same sales, which count once in each land; the sale of an unknown customer is blank.
    assert rows(model, ("Category", "zones.Land"), ("Y", "[Total Revenue]")) == [("here", 23.0), ("there", 12.0), (None, 13.0)]
    assert rows(model, ("Category", "plans.Land"), ("Y", "[Total Orders]")) == [("here", 3), (None, 1)]
    assert rows(model, ("Rows", "people.Zone"), ("Columns", "sales_dashboard.Region"), ("Values", "[Total Revenue]")) == [("N", "North", 12.0), ("S", "South", 11.0), (None, None, 13.0)]


def test_values_of_dimensions(model):
    assert rows(model, ("Category", "zones.Land"), ("Y", "zones.Size"), ("Y", "[Total Revenue]")) == [("far", 5, None), ("here", 6, 23.0), ("there", 3, 12.0), (None, None, 13.0)]
    assert rows(model, ("Values", "plans.Goal")) == [(100,)]
    # No path leads from people to plans against the single direction of people to zones: the goal stands beside every group.
    assert rows(model, ("Category", "people.Kind"), ("Y", "plans.Goal")) == [("gold", 100), (None, 100)]


def test_measures_that_leave_their_context(model):
    assert rows(model, ("Values", "[Revenue YTD]")) == [(23.0,)]
    assert rows(model, ("Category", "sales_dashboard.Region"), ("Y", "[Territory Revenue %]")) == [("North", 12 / 36), ("South", 11 / 36), (None, 13 / 36)]
    assert rows(model, ("Values", "people.Zone"), ("Values", "[Territory Revenue %]"), ("Values", "[Territory Revenue Rank]")) == [("N", 1.0, 2), ("S", 1.0, 3), (None, 1.0, 1)]
    assert rows(model, ("Values", "[Executive Revenue KPI]"), ("Values", "[Executive Margin KPI]")) == [(36.0, 10 / 36)]


def test_lists_and_limits(model):
    assert rows(model, ("Field", "people.Kind")) == [("gold",), (None,)]
    with pytest.raises(ValueError):
        rows(model, ("Field", "people.Kind"), ("Field", "zones.Land"))
    with pytest.raises(ValueError):
        rows(model, ("Rows", "people.Kind"), ("Rows", "zones.Land"), ("Values", "zones.Size"))


def test_fields_come_from_documents_in_order(spark):
    docs = spark.createDataFrame([("a", report.document("tableEx", {"Values": ["t.B", "[M]", "t.A"]})), ("b", report.document("card", {"Values": ["[M]"]}))], "file string, text string")
    found = v.fields_of(semantic_model.visual_fields(docs))
    assert [(f.entity, f.property, f.is_measure) for f in found["a"]] == [("t", "B", False), ("_Measures", "M", True), ("t", "A", False)] and len(found["b"]) == 1

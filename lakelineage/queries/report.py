"""Report visuals over the gold tables, one of each kind, compiled from their JSON documents."""

from __future__ import annotations

import json

from lakelineage.operators import gold
from lakelineage.plans import visuals
from lakelineage.queries.star import registry, star
from lakelineage.sources import semantic_model

QUERIES, ORACLE, query = registry()

# Relationships of the model between gold tables (many side first), and columns that it sums.
RELATIONSHIPS = (
    visuals.Relationship("sales_dashboard", "CustomerID", "customer_360", "CustomerID"),
    visuals.Relationship("customer_360", "Region", "territory_performance", "Region"),
    visuals.Relationship("sales_dashboard", "Region", "territory_performance", "Region", is_active=False),
    visuals.Relationship("executive_summary", "TotalRevenue", "executive_kpi", "TotalRevenue", both=True),
    visuals.Relationship("sales_dashboard", "ProductID", "product_performance", "ProductID"),
    visuals.Relationship("sales_forecasting_base", "YearMonth", "monthly_sales", "YearMonth"),
    visuals.Relationship("sales_dashboard", "YearMonth", "monthly_sales", "YearMonth"),
)
SUMMED = frozenset({("customer_segmentation", "CustomerCount"), ("customer_segmentation", "TotalRevenue"), ("monthly_sales", "Revenue"), ("monthly_sales", "Profit"), ("executive_kpi", "AvgOrderValue"), ("executive_kpi", "TotalOrders")})


def model(spark, d):
    s = star(spark, d)
    return visuals.Model({name: build(s) for name, build in gold.BUILDERS.items() if name != "product_performance"} | {"product_performance": s.product.select("ProductID", "ProductName")}, RELATIONSHIPS, SUMMED)


def document(kind, roles):
    """A visual's document: its kind, and per role its fields as ``Table.Column`` or ``[Measure]``."""

    def projection(name):
        entity, _, prop = (visuals.MEASURE_TABLE, "", name[1:-1]) if name.startswith("[") else name.partition(".")
        return {"field": {"Measure" if name.startswith("[") else "Column": {"Expression": {"SourceRef": {"Entity": entity}}, "Property": prop}}, "queryRef": f"{entity}.{prop}"}

    return json.dumps({"visual": {"visualType": kind, "query": {"queryState": {role: {"projections": [projection(n) for n in names]} for role, names in roles.items()}}}})


def shown(spark, d, kind, short, **roles):
    """The visual over ``d``; ``short`` names its columns for SQL."""
    docs = spark.createDataFrame([("v", document(kind, roles))], "file string, text string")
    fields = visuals.fields_of(semantic_model.visual_fields(docs))["v"]
    out = visuals.compile_visual(model(spark, d), fields)
    return out.toDF(*[short.get(c, c) for c in out.columns])


SHORT = {"Total Revenue": "revenue", "Total Profit": "profit", "Total Customers": "customers", "Profit Margin %": "margin", "MoM Revenue %": "mom", "Revenue YTD": "ytd", "Territory Revenue Rank": "place", "Territory Revenue %": "share", "Product Profit Margin %": "margin", "Total Units Sold": "units", "New Customers": "new_customers", "Executive Margin KPI": "margin"}
REVENUE = "CAST(sum(Revenue) AS DOUBLE) AS revenue"


@query(f"SELECT {REVENUE} FROM sales")
def v_card(spark, d):
    return shown(spark, d, "card", SHORT, Values=["[Total Revenue]"])


@query("SELECT count(DISTINCT CustomerKey) FILTER (first >= (SELECT min(OrderDateKey) FROM sales)) AS new_customers FROM (SELECT CustomerKey, min(OrderDateKey) AS first FROM sales GROUP BY 1)")
def v_card_new_customers(spark, d):
    return shown(spark, d, "card", SHORT, Values=["[New Customers]"])


@query("SELECT CAST(sum(Profit) AS DOUBLE) / CAST(sum(Revenue) AS DOUBLE) AS margin FROM sales")
def v_card_executive_margin(spark, d):
    return shown(spark, d, "card", SHORT, Values=["[Executive Margin KPI]"])


@query("""SELECT Segment, count(*) AS CustomerCount FROM (SELECT CASE WHEN sum(Revenue) >= 10000 THEN 'Platinum' WHEN sum(Revenue) >= 5000 THEN 'Gold' WHEN sum(Revenue) >= 1000 THEN 'Silver' ELSE 'Bronze' END AS Segment FROM sales GROUP BY CustomerKey) GROUP BY 1""")
def v_donut_segments(spark, d):
    return shown(spark, d, "donutChart", SHORT, Category=["customer_segmentation.Segment"], Y=["customer_segmentation.CustomerCount"])


@query(f"SELECT YearMonth, {REVENUE}, CAST(sum(Profit) AS DOUBLE) AS Profit FROM sales LEFT JOIN cal ON OrderDateKey = CalendarKey GROUP BY 1")
def v_line_month(spark, d):
    return shown(spark, d, "lineChart", SHORT, Category=["monthly_sales.YearMonth"], Y=["[Total Revenue]", "monthly_sales.Profit"])


@query("SELECT YearMonth, CAST(sum(Revenue) AS DOUBLE) AS ytd FROM sales JOIN cal ON OrderDateKey = CalendarKey GROUP BY 1")
def v_line_running(spark, d):
    return shown(spark, d, "lineChart", SHORT, Category=["monthly_sales.YearMonth"], Y=["[Revenue YTD]"])


@query(f"SELECT Region, {REVENUE} FROM sales JOIN terr ON SalesTerritoryKey = TerritoryID GROUP BY 1")
def v_bar_region(spark, d):
    return shown(spark, d, "barChart", SHORT, Category=["territory_performance.Region"], Y=["[Total Revenue]"])


@query(f"SELECT ProductName, {REVENUE} FROM sales LEFT JOIN prod ON ProductKey = ProductID GROUP BY 1")
def v_bar_product(spark, d):
    return shown(spark, d, "barChart", SHORT, Category=["sales_dashboard.ProductName"], Y=["[Total Revenue]"])


@query(f"SELECT Region, {REVENUE}, CAST(sum(Profit) AS DOUBLE) AS profit FROM sales JOIN terr ON SalesTerritoryKey = TerritoryID GROUP BY 1")
def v_column_region(spark, d):
    return shown(spark, d, "columnChart", SHORT, Category=["territory_performance.Region"], Y=["[Total Revenue]", "[Total Profit]"])


@query("SELECT DISTINCT CAST(year(OrderDateKey) AS INTEGER) AS Year FROM sales")
def v_slicer_year(spark, d):
    return shown(spark, d, "slicer", SHORT, Field=["monthly_sales.Year"])


@query("""SELECT CASE WHEN r >= 10000 THEN 'Platinum' WHEN r >= 5000 THEN 'Gold' WHEN r >= 1000 THEN 'Silver' ELSE 'Bronze' END AS RevenueCategory, count(*) AS customers FROM (SELECT CustomerKey, sum(Revenue) AS r FROM sales GROUP BY 1) GROUP BY 1""")
def v_pie_category(spark, d):
    return shown(spark, d, "pieChart", SHORT, Category=["customer_360.RevenueCategory"], Y=["[Total Customers]"])


# The map's countries filter customers by their region, since that is what the relationship holds.
@query(f"SELECT Country, revenue FROM terr JOIN (SELECT Region, {REVENUE} FROM sales JOIN terr ON SalesTerritoryKey = TerritoryID GROUP BY 1) USING (Region)")
def v_map_country(spark, d):
    return shown(spark, d, "filledMap", SHORT, Location=["territory_performance.Country"], Y=["[Total Revenue]"])


@query(f"""SELECT ProductName, {REVENUE}, CAST(sum(Profit) AS DOUBLE) AS profit, CAST(sum(Profit) AS DOUBLE) / CAST(sum(Revenue) AS DOUBLE) AS margin, CAST(sum(OrderQuantity) AS BIGINT) AS units
 FROM sales LEFT JOIN prod ON ProductKey = ProductID GROUP BY 1""")
def v_table_product(spark, d):
    return shown(spark, d, "tableEx", SHORT, Values=["product_performance.ProductName", "[Total Revenue]", "[Total Profit]", "[Product Profit Margin %]", "[Total Units Sold]"])


@query(f"""SELECT Region, {REVENUE}, CAST(dense_rank() OVER (ORDER BY sum(Revenue) DESC) AS INTEGER) AS place, 1.0 AS share FROM sales JOIN terr ON SalesTerritoryKey = TerritoryID GROUP BY 1""")
def v_table_ranking(spark, d):
    return shown(spark, d, "tableEx", SHORT, Values=["territory_performance.Region", "[Total Revenue]", "[Territory Revenue Rank]", "[Territory Revenue %]"])


@query(f"""WITH s AS (SELECT *, OrderDateKey AS day FROM sales LEFT JOIN prod ON ProductKey = ProductID), moved AS (SELECT DISTINCT ProductName, day - INTERVAL 1 MONTH AS day FROM s),
 b AS (SELECT s.ProductName, CAST(sum(Revenue) AS DOUBLE) AS before FROM s JOIN moved m ON m.ProductName = s.ProductName AND m.day = s.day GROUP BY 1)
 SELECT ProductName, {REVENUE}, (CAST(sum(Revenue) AS DOUBLE) - max(before)) / max(before) AS mom, CAST(sum(Profit) AS DOUBLE) AS profit FROM s LEFT JOIN b USING (ProductName) GROUP BY 1""".replace("WITH s AS", "SELECT * FROM (WITH s AS") + ")")
def v_table_change(spark, d):
    return shown(spark, d, "tableEx", SHORT, Values=["sales_dashboard.ProductName", "[Total Revenue]", "[MoM Revenue %]", "[Total Profit]"])

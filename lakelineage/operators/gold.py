"""Silver to gold: the ten published tables. Each is one lazy plan, but for product ranks, which are sorted in ranges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakelineage.functions.lineage import cut, ranked

# Lifetime revenue from which a customer is of a tier, and the order of tiers.
TIERS = {"Platinum": 10000, "Gold": 5000, "Silver": 1000, "Bronze": None}
TIER_ORDER = {"Platinum": 1, "Gold": 2, "Silver": 3, "Bronze": 4}
HIGH_VALUE = 5000
TOP_SHARE = 0.10


@dataclass(frozen=True)
class Star:
    sales: DataFrame
    customer: DataFrame
    product: DataFrame
    calendar: DataFrame
    territory: DataFrame


def rounded(total: Column) -> Column:
    """Two decimals, as double; decimals are rounded before the cast."""
    return F.round(total, 2).cast("double")


def percent(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")) * 100, 2)


def tier(revenue: Column) -> Column:
    label: Column = F.lit("Bronze")
    for name, least in reversed(TIERS.items()):
        if least is not None:
            label = F.when(revenue >= least, name).otherwise(label)
    return label


def sales_dashboard(s: Star) -> DataFrame:
    """Every sale with the attributes of its customer, product, day and territory."""
    customer = s.customer.select("CustomerID", F.col("FullName").alias("CustomerName"))
    product = s.product.select("ProductID", "ProductName")
    days = s.calendar.select("CalendarKey", F.col("CalendarDate").alias("OrderDate"), F.col("CalendarYear").alias("Year"), "Quarter", F.col("MonthName").alias("Month"), "YearMonth")
    territory = s.territory.select("TerritoryID", "Country", "Region")
    wide = s.sales
    for dim, key, own in ((customer, "CustomerID", "CustomerKey"), (product, "ProductID", "ProductKey"), (days, "CalendarKey", "OrderDateKey"), (territory, "TerritoryID", "SalesTerritoryKey")):
        wide = wide.drop(*[c for c in dim.columns if c in wide.columns]).join(dim, F.col(own) == F.col(key), "left")
    return wide.select(
        "OrderNumber", "CustomerID", "CustomerName", "ProductID", "ProductName", "OrderDate", "Year", "Quarter", "Month", "YearMonth", "Country", "Region", "Revenue", "ProductCost", "Profit", "ProfitMargin",
        "FreightCost", "Tax", "OrderQuantity",
    )


def customer_360(s: Star) -> DataFrame:
    life = s.sales.groupBy("CustomerKey").agg(
        rounded(F.sum("Revenue")).alias("LifetimeRevenue"), F.countDistinct("OrderNumber").alias("TotalOrders"), rounded(F.avg("Revenue")).alias("AvgOrderValue"), F.max("OrderDateKey").alias("LastPurchaseDateKey")
    )
    places = s.territory.select("TerritoryID", "Country", "Region", "TerritoryGroup")
    everyone = s.customer.join(life, F.col("CustomerID") == F.col("CustomerKey"), "left").join(places, F.col("GeographyKey") == F.col("TerritoryID"), "left")
    return everyone.select(
        "CustomerID", "CustomerCode", "FullName", "Age", "AgeGroup", "Country", "Region", "TerritoryGroup", "LifetimeRevenue", "TotalOrders", "AvgOrderValue", "LastPurchaseDateKey",
        F.coalesce(F.col("LifetimeRevenue") >= HIGH_VALUE, F.lit(False)).alias("HighValueCustomer"), tier(F.col("LifetimeRevenue")).alias("RevenueCategory"),
    )


def product_performance(s: Star) -> DataFrame:
    """Ranks are found in ranges of products, in many tasks. The first tenth of the products that were sold are top performers."""
    sold = s.sales.groupBy("ProductKey").agg(
        rounded(F.sum("Revenue")).alias("TotalRevenue"), rounded(F.sum("Profit")).alias("TotalProfit"), F.sum("OrderQuantity").alias("UnitsSold"), rounded(F.avg("Revenue")).alias("AvgSellingPrice")
    )
    all_ = s.product.select("ProductID", "ProductName").join(sold, F.col("ProductID") == F.col("ProductKey"), "left")
    all_ = cut(all_)
    placed = ranked(ranked(all_, "TotalRevenue", "RevenueRank"), "TotalProfit", "ProfitRank")
    top = F.greatest(F.lit(1), F.floor(all_.agg(F.count("ProductKey")).scalar() * TOP_SHARE))
    return placed.select(
        "ProductID", "ProductName", "TotalRevenue", "TotalProfit", percent(F.col("TotalProfit"), F.col("TotalRevenue")).alias("ProductProfitMargin"), "UnitsSold", "AvgSellingPrice",
        "RevenueRank", "ProfitRank", (F.col("RevenueRank") <= top).alias("TopPerformer"),
    )


def territory_performance(s: Star) -> DataFrame:
    sold = s.sales.groupBy("SalesTerritoryKey").agg(rounded(F.sum("Revenue")).alias("TotalRevenue"), rounded(F.sum("Profit")).alias("TotalProfit"), F.countDistinct("CustomerKey").alias("CustomerCount"))
    most = sold.join(s.territory, F.col("TerritoryID") == F.col("SalesTerritoryKey"), "left_semi").agg(F.max("TotalRevenue"))
    all_ = s.territory.join(sold, F.col("TerritoryID") == F.col("SalesTerritoryKey"), "left")
    return all_.select(
        "Country", "Region", "TerritoryGroup", "TotalRevenue", "TotalProfit", "CustomerCount", F.round(F.try_divide("TotalRevenue", "CustomerCount"), 2).alias("AvgRevenuePerCustomer"),
        F.col("TotalRevenue").eqNullSafe(most.scalar()).alias("TopTerritory"),
    )


def monthly_sales(s: Star) -> DataFrame:
    days = s.calendar.select("CalendarKey", F.col("CalendarYear").alias("Year"), "Quarter", "MonthNumberOfYear", "MonthName", "YearMonth")
    dated = s.sales.join(days, F.col("OrderDateKey") == F.col("CalendarKey"), "left")
    return dated.groupBy("Year", "Quarter", "MonthNumberOfYear", "MonthName", "YearMonth").agg(
        rounded(F.sum("Revenue")).alias("Revenue"), rounded(F.sum("Profit")).alias("Profit"), percent(F.sum("Profit"), F.sum("Revenue")).alias("ProfitMargin"),
        F.countDistinct("OrderNumber").alias("OrderCount"), F.countDistinct("CustomerKey").alias("CustomerCount"), F.countDistinct("ProductKey").alias("ProductCount"),
    )


def executive_totals(s: Star) -> DataFrame:
    """One row of totals, distinct counts and leaders, from one scan of the sales.

    Sales are grouped by each of five keys at once (GROUPING SETS). A distinct count is the number of groups of its key;
    revenue by product, territory and day carries the leaders. Groups of customers and orders are then only counted, so
    the rows that meet the dimensions are as few as products, territories and days. Of equal leaders, that with the
    smallest name counts.
    """
    keys = ("CustomerKey", "OrderNumber", "ProductKey", "SalesTerritoryKey", "OrderDateKey")
    sets = s.sales.select(*keys, "Revenue", "Profit").groupingSets([[k] for k in keys], *keys)
    groups = sets.agg(F.grouping_id().alias("_set"), F.sum("Revenue").alias("_total"), F.sum("Profit").alias("_profit"), F.count("Revenue").alias("_n"))
    of = {k: F.col("_set") == (31 ^ (16 >> i)) for i, k in enumerate(keys)}  # a bit is set for each key that is not in the set
    small = [F.when(of[k], F.col(k)).alias(k) for k in keys[2:]]
    few = groups.groupBy("_set", *small).agg(
        F.sum("_total").alias("_total"), F.sum("_profit").alias("_profit"), F.sum("_n").alias("_n"), *[F.count(F.when(of[k], F.col(k))).alias(f"_{k}") for k in keys[:3]]
    )
    days = s.calendar.select("CalendarKey", F.col("YearMonth").alias("_month"), F.concat_ws("-Q", F.col("CalendarYear").cast("string"), F.col("Quarter").cast("string")).alias("_quarter"))
    known = few.join(s.product.select("ProductID", F.col("ProductName").alias("_product")), F.col("ProductKey") == F.col("ProductID"), "left")
    known = known.join(s.territory.select("TerritoryID", F.col("Country").alias("_country")), F.col("SalesTerritoryKey") == F.col("TerritoryID"), "left").join(days, F.col("OrderDateKey") == F.col("CalendarKey"), "left")
    named = lambda kind, name: F.struct(F.lit(kind).alias("kind"), F.col(name).cast("string").alias("name"))
    labels = F.when(of["ProductKey"], F.array(named("product", "_product"))).when(of["SalesTerritoryKey"], F.array(named("territory", "_country"))).when(of["OrderDateKey"], F.array(named("month", "_month"), named("quarter", "_quarter")))
    labels = F.coalesce(labels, F.array(F.struct(F.lit("counts").alias("kind"), F.lit(None).cast("string").alias("name"))))
    rows = known.withColumn("_label", F.explode(labels)).groupBy("_label.kind", "_label.name").agg(
        F.sum("_total").alias("_total"), F.sum("_profit").alias("_profit"), F.sum("_n").alias("_n"), *[F.sum(f"_{k}").alias(f"_{k}") for k in keys[:3]]
    )
    best = lambda kind: F.min_by("name", F.when(F.col("kind") == kind, F.struct(-F.col("_total"), F.col("name"))))
    month = lambda c: F.sum(F.when(F.col("kind") == "month", F.col(c)))  # noqa: E731  a sale is in one month
    revenue, profit = month("_total"), month("_profit")
    count = lambda k: F.coalesce(F.sum(f"_{k}"), F.lit(0)).alias(k)
    return rows.agg(
        rounded(revenue).alias("TotalRevenue"), rounded(profit).alias("TotalProfit"), percent(profit, revenue).alias("ProfitMargin"), count("CustomerKey"), count("ProductKey"), count("OrderNumber"),
        rounded(F.try_divide(revenue, month("_n"))).alias("AvgOrderValue"), best("territory").alias("Territory"), best("product").alias("Product"), best("month").alias("Month"), best("quarter").alias("Quarter"),
    )


def executive_kpi(s: Star) -> DataFrame:
    """One row of totals and leaders."""
    return executive_totals(s).select(
        "TotalRevenue", "TotalProfit", "ProfitMargin", F.col("CustomerKey").alias("TotalCustomers"), F.col("ProductKey").alias("TotalProducts"), F.col("OrderNumber").alias("TotalOrders"), "AvgOrderValue",
        F.round(F.try_divide("TotalRevenue", "CustomerKey"), 2).alias("AvgCustomerRevenue"), F.col("Territory").alias("HighestRevenueTerritory"), F.col("Product").alias("HighestRevenueProduct"),
    )


def customer_segmentation(s: Star) -> DataFrame:
    life = s.sales.groupBy("CustomerKey").agg(rounded(F.sum("Revenue")).cast("decimal(18,2)").alias("life"), F.round(F.avg("Revenue"), 2).cast("decimal(18,2)").alias("order"), F.round(F.avg("Profit"), 2).cast("decimal(18,2)").alias("profit"))
    place = F.create_map(*[F.lit(x) for kv in TIER_ORDER.items() for x in kv])
    segments = life.groupBy(tier(F.col("life")).alias("Segment")).agg(
        F.count("CustomerKey").alias("CustomerCount"), rounded(F.sum("life")).alias("TotalRevenue"), rounded(F.avg("order")).alias("AvgOrderValue"), rounded(F.avg("profit")).alias("AvgProfit")
    )
    return segments.orderBy(F.element_at(place, F.col("Segment")))  # four rows


def sales_forecasting_base(s: Star) -> DataFrame:
    """Revenue by day."""
    days = s.calendar.select("CalendarKey", F.col("CalendarDate").alias("Date"), F.col("CalendarYear").alias("Year"), F.col("MonthNumberOfYear").alias("Month"), "YearMonth")
    dated = s.sales.join(days, F.col("OrderDateKey") == F.col("CalendarKey"), "left")
    return dated.groupBy("Date", "Year", "Month", "YearMonth").agg(rounded(F.sum("Revenue")).alias("Revenue"), rounded(F.sum("Profit")).alias("Profit"), F.countDistinct("OrderNumber").alias("OrderCount"))


def executive_summary(s: Star) -> DataFrame:
    """One row: totals, the leading territory and product, and the best month and quarter."""
    return executive_totals(s).select(
        "TotalRevenue", "TotalProfit", F.col("CustomerKey").alias("CustomerCount"), F.col("ProductKey").alias("ProductCount"), F.col("Territory").alias("TopTerritory"), F.col("Product").alias("TopProduct"),
        F.col("Month").alias("HighestRevenueMonth"), F.col("Quarter").alias("HighestRevenueQuarter"),
    )


# Domain, key, sources and classification of each published table.
CATALOG = {
    "sales_dashboard": ("Sales", "OrderNumber", "silver.sales,silver.customer,silver.product,silver.calendar,silver.sales_territory", "Internal"),
    "customer_360": ("Customer", "CustomerID", "silver.customer,silver.sales,silver.sales_territory", "Internal"),
    "product_performance": ("Product", "ProductID", "silver.product,silver.sales", "Internal"),
    "territory_performance": ("Sales", "TerritoryID", "silver.sales_territory,silver.sales", "Internal"),
    "monthly_sales": ("Sales", "YearMonth", "silver.sales,silver.calendar", "Internal"),
    "executive_kpi": ("Executive", "N/A", "silver.sales,silver.sales_territory,silver.product", "Confidential"),
    "customer_segmentation": ("Customer", "Segment", "silver.sales", "Internal"),
    "sales_forecasting_base": ("Sales", "YearMonth", "silver.sales,silver.calendar", "Internal"),
    "executive_summary": ("Executive", "N/A", "silver.sales,silver.sales_territory,silver.product,silver.calendar", "Confidential"),
    "metadata_catalog": ("Metadata", "TableName", "gold.*", "Internal"),
}


def metadata_catalog(counts: DataFrame, refreshed: Column) -> DataFrame:
    """A row per published table. ``counts``: ``table``, ``rows``, such as a run's metrics; 0 where it has none."""
    spark = counts.sparkSession
    known = spark.createDataFrame([(t, *v) for t, v in CATALOG.items()], "table string, BusinessDomain string, PrimaryKey string, SourceTables string, DataClassification string")
    rows = F.when(F.col("table") == "metadata_catalog", F.lit(len(CATALOG))).otherwise(F.coalesce("rows", F.lit(0)))
    return F.broadcast(known).join(counts, "table", "left").select(
        F.concat(F.lit("gold."), "table").alias("TableName"), "BusinessDomain", "PrimaryKey", rows.cast("long").alias("RecordCount"), refreshed.alias("RefreshTimestamp"), "SourceTables",
        F.lit("Data Engineering").alias("Owner"), "DataClassification",
    )


BUILDERS = {f.__name__: f for f in (sales_dashboard, customer_360, product_performance, territory_performance, monthly_sales, executive_kpi, customer_segmentation, sales_forecasting_base, executive_summary)}

"""Silver, gold and SQL-object queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from lakelineage.operators import gold, silver, sql_objects
from lakelineage.queries.star import avg2, raw_sales, read, registry, star

QUERIES, ORACLE, query = registry()


@query("SELECT OrderNumber, ProductKey, CAST(Revenue AS DOUBLE) AS Revenue, CAST(ProductCost AS DOUBLE) AS ProductCost, CAST(Profit AS DOUBLE) AS Profit, ProfitMargin FROM sales")
def silver_rename_derive_sales(spark, d):
    as_double = lambda c: F.col(c).cast("double").alias(c)
    return silver.sales(raw_sales(spark, d)).select("OrderNumber", "ProductKey", *map(as_double, ("Revenue", "ProductCost", "Profit")), "ProfitMargin")


@query("""SELECT p_partkey, CASE WHEN p_size BETWEEN 18 AND 25 THEN '18-25' WHEN p_size BETWEEN 26 AND 35 THEN '26-35' WHEN p_size BETWEEN 36 AND 45 THEN '36-45'
 WHEN p_size BETWEEN 46 AND 60 THEN '46-60' ELSE '60+' END AS bucket FROM part""", False)
def silver_bucket_case(spark, d):
    return read(spark, d, "part").select("p_partkey", silver.age_group(F.col("p_size")).alias("bucket"))


@query("SELECT p_partkey, CASE WHEN upper(trim(b)) IN ('NULL','N/A','NA','NONE','') THEN NULL ELSE b END AS brand FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN ' n/a ' ELSE p_brand END AS b FROM part)", False)
def silver_sentinel_null(spark, d):
    return silver.null_sentinels(read(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, " n/a ").otherwise(F.col("p_brand")).alias("brand")))


@query("SELECT c_custkey AS CustomerID, concat_ws(' ', c_name, c_mktsegment) AS FullName, CAST(2020 - (1950 + c_custkey % 50) AS INTEGER) AS Age FROM customer", False)
def silver_full_name_concat(spark, d):
    raw = read(spark, d, "customer").select(
        F.col("c_custkey").alias("CustomerKey"), F.col("c_name").alias("CustomerAlternateKey"), F.col("c_name").alias("FirstName"), F.col("c_mktsegment").alias("LastName"),
        F.make_date((1950 + F.col("c_custkey") % 50).cast("int"), F.lit(6), F.lit(1)).alias("BirthDate"),
    )
    return silver.customers(raw, as_of=F.lit("2020-03-01").cast("date")).select("CustomerID", "FullName", "Age")


@query("SELECT CalendarKey, CalendarYear, Quarter, MonthNumberOfYear, MonthName, YearMonth FROM cal", dates=("CalendarKey",))
def silver_calendar(spark, d):
    return star(spark, d).calendar.select("CalendarKey", "CalendarYear", "Quarter", "MonthNumberOfYear", "MonthName", "YearMonth")


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1", False)
def silver_dedup_first(spark, d):
    return silver.first_of(read(spark, d, "orders"), ["o_custkey"], F.col("o_orderdate"), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("""SELECT OrderNumber, CustomerID, FullName AS CustomerName, ProductID, ProductName, CalendarDate AS OrderDate, CalendarYear AS Year, Quarter, MonthName AS Month, YearMonth, Country, Region,
 CAST(Revenue AS DOUBLE) AS Revenue, CAST(ProductCost AS DOUBLE) AS ProductCost, CAST(Profit AS DOUBLE) AS Profit, ProfitMargin, CAST(Tax AS DOUBLE) AS Tax, OrderQuantity
 FROM sales LEFT JOIN cust ON CustomerKey = CustomerID LEFT JOIN prod ON ProductKey = ProductID LEFT JOIN cal ON OrderDateKey = CalendarKey LEFT JOIN terr ON SalesTerritoryKey = TerritoryID""", dates=("OrderDate",))
def gold_sales_dashboard(spark, d):
    out = gold.sales_dashboard(star(spark, d)).drop("FreightCost")
    return out.withColumns({c: F.col(c).cast("double") for c in ("Revenue", "ProductCost", "Profit", "Tax")})


@query(f"""SELECT CustomerID, CustomerCode, FullName, Age, AgeGroup, Country, Region, TerritoryGroup, CAST(life AS DOUBLE) AS LifetimeRevenue, TotalOrders, AvgOrderValue, LastPurchaseDateKey,
 coalesce(life >= 5000, false) AS HighValueCustomer, CASE WHEN life >= 10000 THEN 'Platinum' WHEN life >= 5000 THEN 'Gold' WHEN life >= 1000 THEN 'Silver' ELSE 'Bronze' END AS RevenueCategory
 FROM cust LEFT JOIN (SELECT CustomerKey, sum(Revenue) AS life, count(DISTINCT OrderNumber) AS TotalOrders, {avg2('sum(Revenue)', 'count(*)')} AS AvgOrderValue, max(OrderDateKey) AS LastPurchaseDateKey FROM sales GROUP BY 1)
 ON CustomerID = CustomerKey LEFT JOIN terr ON GeographyKey = TerritoryID""", dates=("LastPurchaseDateKey",))
def gold_customer_360(spark, d):
    return gold.customer_360(star(spark, d))


@query(f"""SELECT ProductID, ProductName, CAST(r AS DOUBLE) AS TotalRevenue, CAST(p AS DOUBLE) AS TotalProfit, round(CAST(p AS DOUBLE) / nullif(CAST(r AS DOUBLE), 0) * 100, 2) AS ProductProfitMargin, CAST(UnitsSold AS BIGINT) AS UnitsSold,
 AvgSellingPrice, CAST(rank() OVER (ORDER BY r DESC NULLS LAST) AS INTEGER) AS RevenueRank, CAST(rank() OVER (ORDER BY p DESC NULLS LAST) AS INTEGER) AS ProfitRank,
 rank() OVER (ORDER BY r DESC NULLS LAST) <= greatest(1, floor(count(k) OVER () * 0.1)) AS TopPerformer
 FROM prod LEFT JOIN (SELECT ProductKey AS k, sum(Revenue) AS r, sum(Profit) AS p, sum(OrderQuantity) AS UnitsSold, {avg2('sum(Revenue)', 'count(*)')} AS AvgSellingPrice FROM sales GROUP BY 1) ON ProductID = k""")
def gold_product_performance(spark, d):
    return gold.product_performance(star(spark, d))


@query("""SELECT Country, Region, TerritoryGroup, CAST(r AS DOUBLE) AS TotalRevenue, CAST(p AS DOUBLE) AS TotalProfit, CustomerCount, round(CAST(r AS DOUBLE) / nullif(CustomerCount, 0), 2) AS AvgRevenuePerCustomer,
 rank() OVER (ORDER BY r DESC NULLS LAST) = 1 AS TopTerritory
 FROM terr LEFT JOIN (SELECT SalesTerritoryKey AS k, sum(Revenue) AS r, sum(Profit) AS p, count(DISTINCT CustomerKey) AS CustomerCount FROM sales GROUP BY 1) ON TerritoryID = k""")
def gold_territory_performance(spark, d):
    return gold.territory_performance(star(spark, d))


@query("""SELECT CalendarYear AS Year, Quarter, MonthNumberOfYear, MonthName, YearMonth, CAST(sum(Revenue) AS DOUBLE) AS Revenue, CAST(sum(Profit) AS DOUBLE) AS Profit,
 round(CAST(sum(Profit) AS DOUBLE) / nullif(CAST(sum(Revenue) AS DOUBLE), 0) * 100, 2) AS ProfitMargin, count(DISTINCT OrderNumber) AS OrderCount, count(DISTINCT CustomerKey) AS CustomerCount, count(DISTINCT ProductKey) AS ProductCount
 FROM sales LEFT JOIN cal ON OrderDateKey = CalendarKey GROUP BY 1, 2, 3, 4, 5""")
def gold_monthly_sales(spark, d):
    return gold.monthly_sales(star(spark, d))


LEADERS = """(SELECT Country FROM sales LEFT JOIN terr ON SalesTerritoryKey = TerritoryID GROUP BY 1 ORDER BY sum(Revenue) DESC, Country LIMIT 1) AS {0},
 (SELECT ProductName FROM sales LEFT JOIN prod ON ProductKey = ProductID GROUP BY 1 ORDER BY sum(Revenue) DESC, ProductName LIMIT 1) AS {1}"""


@query(f"""SELECT CAST(sum(Revenue) AS DOUBLE) AS TotalRevenue, CAST(sum(Profit) AS DOUBLE) AS TotalProfit, round(CAST(sum(Profit) AS DOUBLE) / CAST(sum(Revenue) AS DOUBLE) * 100, 2) AS ProfitMargin,
 count(DISTINCT CustomerKey) AS TotalCustomers, count(DISTINCT ProductKey) AS TotalProducts, count(DISTINCT OrderNumber) AS TotalOrders, {avg2('sum(Revenue)', 'count(*)')} AS AvgOrderValue,
 round(CAST(sum(Revenue) AS DOUBLE) / count(DISTINCT CustomerKey), 2) AS AvgCustomerRevenue, {LEADERS.format('HighestRevenueTerritory', 'HighestRevenueProduct')} FROM sales""")
def gold_executive_kpi(spark, d):
    return gold.executive_kpi(star(spark, d))


@query(f"""SELECT Segment, count(*) AS CustomerCount, CAST(sum(life) AS DOUBLE) AS TotalRevenue, {avg2('sum(o)', 'count(*)')} AS AvgOrderValue, {avg2('sum(p)', 'count(*)')} AS AvgProfit
 FROM (SELECT sum(Revenue) AS life, CAST({avg2('sum(Revenue)', 'count(*)')} AS DECIMAL(18,2)) AS o, CAST({avg2('sum(Profit)', 'count(*)')} AS DECIMAL(18,2)) AS p,
 CASE WHEN sum(Revenue) >= 10000 THEN 'Platinum' WHEN sum(Revenue) >= 5000 THEN 'Gold' WHEN sum(Revenue) >= 1000 THEN 'Silver' ELSE 'Bronze' END AS Segment FROM sales GROUP BY CustomerKey) GROUP BY 1""")
def gold_customer_segmentation(spark, d):
    return gold.customer_segmentation(star(spark, d))


@query("""SELECT CalendarDate AS Date, CalendarYear AS Year, MonthNumberOfYear AS Month, YearMonth, CAST(sum(Revenue) AS DOUBLE) AS Revenue, CAST(sum(Profit) AS DOUBLE) AS Profit, count(DISTINCT OrderNumber) AS OrderCount
 FROM sales LEFT JOIN cal ON OrderDateKey = CalendarKey GROUP BY 1, 2, 3, 4""", dates=("Date",))
def gold_sales_forecasting_base(spark, d):
    return gold.sales_forecasting_base(star(spark, d))


@query(f"""SELECT CAST(sum(Revenue) AS DOUBLE) AS TotalRevenue, CAST(sum(Profit) AS DOUBLE) AS TotalProfit, count(DISTINCT CustomerKey) AS CustomerCount, count(DISTINCT ProductKey) AS ProductCount,
 {LEADERS.format('TopTerritory', 'TopProduct')},
 (SELECT YearMonth FROM sales LEFT JOIN cal ON OrderDateKey = CalendarKey GROUP BY 1 ORDER BY sum(Revenue) DESC, 1 LIMIT 1) AS HighestRevenueMonth,
 (SELECT CalendarYear || '-Q' || Quarter FROM sales LEFT JOIN cal ON OrderDateKey = CalendarKey GROUP BY 1 ORDER BY sum(Revenue) DESC, 1 LIMIT 1) AS HighestRevenueQuarter FROM sales""")
def gold_executive_summary(spark, d):
    return gold.executive_summary(star(spark, d))


CATALOG_SQL = " UNION ALL ".join(
    f"SELECT 'gold.{t}' AS TableName, '{v[0]}' AS BusinessDomain, '{v[1]}' AS PrimaryKey, CAST({n} AS BIGINT) AS RecordCount, '2020-01-01' AS RefreshTimestamp, '{v[2]}' AS SourceTables, 'Data Engineering' AS Owner, '{v[3]}' AS DataClassification"
    for (t, v), n in zip(gold.CATALOG.items(), ["(SELECT count(*) FROM lineitem)", "(SELECT count(*) FROM customer)"] + ["0"] * 7 + ["10"], strict=True)
)


@query(CATALOG_SQL, False)
def gold_metadata_catalog(spark, d):
    counts = read(spark, d, "lineitem").agg(F.lit("sales_dashboard").alias("table"), F.count("*").alias("rows")).unionByName(read(spark, d, "customer").agg(F.lit("customer_360").alias("table"), F.count("*").alias("rows")))
    return gold.metadata_catalog(counts, F.lit("2020-01-01"))


# The sales database: the star under the names that its views use.
def _db(spark, d):
    s = star(spark, d)
    sales = s.sales.select(
        F.col("OrderNumber").alias("sales_order_key"), F.col("CustomerKey").alias("customer_key"), F.col("ProductKey").alias("product_key"), F.col("SalesTerritoryKey").alias("territory_key"), F.col("OrderDateKey").alias("order_date_key"),
        F.col("OrderQuantity").alias("order_quantity"), F.col("Revenue").alias("sales_amount"), F.col("Tax").alias("tax_amount"), F.col("ProductCost").alias("unit_price"),
    )
    day = s.calendar.select(F.col("CalendarKey").alias("date_key"), F.col("CalendarDate").alias("full_date"), F.col("CalendarYear").alias("year"), F.col("MonthNumberOfYear").alias("month"), F.col("MonthName").alias("month_name"))
    territory = s.territory.select(F.col("TerritoryID").alias("territory_key"), F.col("Country").alias("territory_name"), F.col("Country").alias("country"), F.col("Region").alias("region"))
    product = read(spark, d, "part").select(F.col("p_partkey").alias("product_key"), F.col("p_name").alias("product_name"), F.col("p_brand").alias("category"), F.col("p_type").alias("subcategory"))
    customer = read(spark, d, "customer").select(F.col("c_custkey").alias("customer_key"), F.col("c_name").alias("last_name"), F.col("c_nationkey").alias("territory_key"))
    return sales, day, territory, product, customer


@query("SELECT CustomerID AS customer_key, CustomerCode AS last_name, GeographyKey AS territory_key, Country AS territory_name, Country AS country, Region AS region FROM cust LEFT JOIN terr ON GeographyKey = TerritoryID")
def vw_customer_360(spark, d):
    _, _, territory, _, customer = _db(spark, d)
    return sql_objects.vw_customer_360(customer, territory)


@query("""SELECT CalendarYear AS year, MonthNumberOfYear AS month, MonthName AS month_name, Country AS territory_name, Country AS country, count(DISTINCT OrderNumber) AS order_count, CAST(sum(OrderQuantity) AS BIGINT) AS total_units_sold,
 CAST(sum(Revenue) AS DOUBLE) AS total_sales_amount, CAST(sum(Tax) AS DOUBLE) AS total_tax, CAST(sum(Revenue) AS DOUBLE) / count(*) AS avg_order_value
 FROM sales JOIN cal ON OrderDateKey = CalendarKey JOIN terr ON SalesTerritoryKey = TerritoryID GROUP BY 1, 2, 3, 4, 5""")
def vw_monthly_sales(spark, d):
    sales, day, territory, _, _ = _db(spark, d)
    return sql_objects.vw_monthly_sales(sales, day, territory)


@query("""SELECT TerritoryID AS territory_key, Country AS territory_name, Country AS country, Region AS region, count(DISTINCT OrderNumber) AS total_orders, count(DISTINCT CustomerKey) AS unique_customers,
 CAST(sum(Revenue) AS DOUBLE) AS total_revenue, CAST(sum(Revenue) AS DOUBLE) / count(*) AS avg_order_value FROM sales JOIN terr ON SalesTerritoryKey = TerritoryID GROUP BY 1, 2, 3, 4""")
def vw_territory_performance(spark, d):
    sales, _, territory, _, _ = _db(spark, d)
    return sql_objects.vw_territory_performance(sales, territory)


@query("""SELECT p_partkey AS product_key, p_name AS product_name, p_brand AS category, p_type AS subcategory, CAST(sum(OrderQuantity) AS BIGINT) AS total_units_sold, CAST(sum(Revenue) AS DOUBLE) AS total_revenue,
 CAST(sum(ProductCost) AS DOUBLE) / count(*) AS avg_unit_price FROM sales JOIN part ON ProductKey = p_partkey GROUP BY 1, 2, 3, 4""")
def vw_product_sales(spark, d):
    sales, _, _, product, _ = _db(spark, d)
    return sql_objects.vw_product_sales(sales, product)


@query("SELECT CustomerID AS customer_key, CAST(coalesce((SELECT sum(Revenue) FROM sales WHERE CustomerKey = CustomerID), 0) AS DOUBLE) AS lifetime_value FROM cust")
def fn_customer_lifetime_value(spark, d):
    sales, _, _, _, customer = _db(spark, d)
    return sql_objects.fn_customer_lifetime_value(sales, customer)


@query("SELECT OrderNumber AS sales_order_key, ProductKey AS product_key, OrderQuantity AS order_quantity, CAST(Revenue AS DOUBLE) AS sales_amount FROM sales WHERE OrderDateKey BETWEEN DATE '1996-02-01' AND DATE '1996-04-30'")
def fn_sales_by_date_range(spark, d):
    found = sql_objects.fn_sales_by_date_range(_db(spark, d)[0], date(1996, 2, 1), date(1996, 4, 30))
    return found.select("sales_order_key", "product_key", "order_quantity", F.col("sales_amount").cast("double").alias("sales_amount"))


@query("""SELECT p_partkey, CASE WHEN lp IS NULL OR lp = 0 THEN 0.0 ELSE round(CAST(lp - sp AS DOUBLE) / CAST(lp AS DOUBLE) * 100, 2) END AS discount_pct
 FROM (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE CAST(p_retailprice AS DECIMAL(18,2)) END AS lp, CAST(p_size AS DECIMAL(18,2)) AS sp FROM part)""", False)
def fn_discount_percentage(spark, d):
    k = F.col("p_partkey") % 7
    prices = read(spark, d, "part").select("p_partkey", F.when(k == 0, None).when(k == 1, 0).otherwise(F.col("p_retailprice")).cast("decimal(18,2)").alias("list_price"), F.col("p_size").cast("decimal(18,2)").alias("sale_price"))
    return sql_objects.fn_discount_percentage(prices).select("p_partkey", "discount_pct")


@query("SELECT OrderNumber AS sales_order_key, OrderDateKey AS full_date, ProductKey AS product_key, OrderQuantity AS order_quantity, CAST(Revenue AS DOUBLE) AS sales_amount FROM sales WHERE CustomerKey = 7 AND OrderDateKey >= DATE '1996-01-01'", dates=("full_date",))
def usp_customer_orders(spark, d):
    sales, day, *_ = _db(spark, d)
    return sql_objects.usp_customer_orders(sales, day, 7, date(1996, 1, 1))


@query("""SELECT Country AS territory_name, Country AS country, count(DISTINCT OrderNumber) AS total_orders, CAST(sum(Revenue) AS DOUBLE) AS total_revenue
 FROM sales JOIN cal ON OrderDateKey = CalendarKey JOIN terr ON SalesTerritoryKey = TerritoryID WHERE CalendarYear = 1997 GROUP BY 1, 2""")
def usp_territory_summary(spark, d):
    sales, day, territory, *_ = _db(spark, d)
    return sql_objects.usp_territory_summary(sales, day, territory, 1997)


@query("""SELECT ProductKey AS product_key, p_name AS product_name, CAST(sum(OrderQuantity) AS BIGINT) AS total_units, CAST(sum(Revenue) AS DOUBLE) AS total_revenue FROM sales JOIN part ON ProductKey = p_partkey
 WHERE OrderDateKey >= DATE '1997-01-01' GROUP BY 1, 2 ORDER BY sum(Revenue) DESC, 1 LIMIT 10""")
def usp_top_products(spark, d):
    sales, day, _, product, _ = _db(spark, d)
    return sql_objects.usp_top_products(sales, day, product, 10, date(1997, 1, 1))

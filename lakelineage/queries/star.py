"""The test tables in the shape of the silver star schema, for Spark and for DuckDB.

Money is DECIMAL, so that sums don't depend on their order. The cost of a line is our convention (quantity times retail
price), since the tables have none; so are a customer's age and code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelineage.operators import silver
from lakelineage.operators.gold import Star


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines under the names that a landing table has."""
    money = lambda c: F.col(c).cast("decimal(18,2)")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    nation = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    joined = joined.join(nation, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select(
        F.col("o_orderkey").alias("SalesOrderNumber"),
        F.col("o_custkey").alias("CustomerKey"),
        F.col("l_partkey").alias("ProductKey"),
        F.col("c_nationkey").alias("SalesTerritoryKey"),
        F.col("o_orderdate").cast("date").alias("OrderDateKey"),
        F.round(money("l_extendedprice") * (1 - money("l_discount")), 2).cast("decimal(18,2)").alias("SalesAmount"),
        F.round(money("l_quantity") * money("p_retailprice"), 2).cast("decimal(18,2)").alias("TotalProductCost"),
        F.round(money("l_extendedprice") * money("l_tax"), 2).cast("decimal(18,2)").alias("TaxAmt"),
        F.lit(0).cast("decimal(18,2)").alias("Freight"),
        F.col("l_quantity").cast("long").alias("OrderQuantity"),
    )


def star(spark: SparkSession, sf_dir: str) -> Star:
    customer = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("CustomerID"),
        F.col("c_name").alias("CustomerCode"),
        F.concat_ws(" ", "c_name", "c_mktsegment").alias("FullName"),
        (18 + F.col("c_custkey") % 60).cast("int").alias("Age"),
        F.col("c_nationkey").alias("GeographyKey"),
    )
    customer = customer.withColumn("AgeGroup", silver.age_group(F.col("Age")))
    product = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("ProductID"), F.col("p_name").alias("ProductName"))
    territory = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    territory = territory.select(F.col("n_nationkey").alias("TerritoryID"), F.col("n_name").alias("Country"), F.col("r_name").alias("Region"), F.col("r_name").alias("TerritoryGroup"))
    days = read(spark, sf_dir, "orders").agg(F.min(F.col("o_orderdate").cast("date")).alias("first"), F.max(F.col("o_orderdate").cast("date")).alias("last"))
    return Star(silver.sales(raw_sales(spark, sf_dir)), customer, product, silver.calendar_of(days), territory)


#: The same star as DuckDB common table expressions.
STAR_SQL = """
sales AS (
  SELECT *, CAST(Revenue - ProductCost AS DECIMAL(18,2)) AS Profit,
         round((CAST(Revenue AS DOUBLE) - CAST(ProductCost AS DOUBLE)) / nullif(CAST(Revenue AS DOUBLE), 0) * 100, 2) AS ProfitMargin
  FROM (
    SELECT o_orderkey AS OrderNumber, o_custkey AS CustomerKey, l_partkey AS ProductKey, c_nationkey AS SalesTerritoryKey,
           CAST(o_orderdate AS DATE) AS OrderDateKey,
           CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2))), 2) AS DECIMAL(18,2)) AS Revenue,
           CAST(round(CAST(l_quantity AS DECIMAL(18,2)) * CAST(p_retailprice AS DECIMAL(18,2)), 2) AS DECIMAL(18,2)) AS ProductCost,
           CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(18,2)), 2) AS DECIMAL(18,2)) AS Tax,
           CAST(0 AS DECIMAL(18,2)) AS FreightCost, CAST(l_quantity AS BIGINT) AS OrderQuantity
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN customer ON o_custkey = c_custkey
  )
), cust AS (
  SELECT c_custkey AS CustomerID, c_name AS CustomerCode, concat_ws(' ', c_name, c_mktsegment) AS FullName,
         CAST(18 + c_custkey % 60 AS INTEGER) AS Age, c_nationkey AS GeographyKey,
         CASE WHEN 18 + c_custkey % 60 BETWEEN 18 AND 25 THEN '18-25' WHEN 18 + c_custkey % 60 BETWEEN 26 AND 35 THEN '26-35'
              WHEN 18 + c_custkey % 60 BETWEEN 36 AND 45 THEN '36-45' WHEN 18 + c_custkey % 60 BETWEEN 46 AND 60 THEN '46-60' ELSE '60+' END AS AgeGroup
  FROM customer
), prod AS (SELECT p_partkey AS ProductID, p_name AS ProductName FROM part
), terr AS (SELECT n_nationkey AS TerritoryID, n_name AS Country, r_name AS Region, r_name AS TerritoryGroup FROM nation JOIN region ON n_regionkey = r_regionkey
), cal AS (
  SELECT d AS CalendarKey, d AS CalendarDate, CAST(year(d) AS INTEGER) AS CalendarYear, CAST(quarter(d) AS INTEGER) AS Quarter,
         CAST(month(d) AS INTEGER) AS MonthNumberOfYear, strftime(d, '%B') AS MonthName, strftime(d, '%Y-%m') AS YearMonth
  FROM (SELECT CAST(unnest(generate_series(date_trunc('year', min(o_orderdate)), date_trunc('year', max(o_orderdate)) + INTERVAL 1 YEAR - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS d FROM orders)
)"""


def avg2(total: str, n: str) -> str:
    """SQL for total / n, of two decimals, rounded half up to two decimals exactly."""
    return f"(CASE WHEN {total} < 0 THEN -1 ELSE 1 END * ((2 * abs(CAST({total} * 100 AS HUGEINT)) + {n}) // (2 * {n}))) / 100.0"


def registry():
    """Queries and their SQL by name, and a decorator that adds to both. ``dates`` leave both engines as text."""
    queries, oracle = {}, {}

    def query(sql: str | None, with_star: bool = True, dates: tuple[str, ...] = ()):
        def add(f):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in dates})

            queries[f.__name__] = run if dates else f
            if sql is not None:
                text = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in dates)}) FROM ({sql})" if dates else sql
                oracle[f.__name__] = f"WITH {STAR_SQL}\n{text}" if with_star else text
            return f

        return add

    return queries, oracle, query

"""Measure queries, over the gold sales dashboard."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakelineage.operators import gold
from lakelineage.operators import measures as m
from lakelineage.queries.star import registry, star

QUERIES, ORACLE, query = registry()
DASH = "(SELECT * FROM sales LEFT JOIN prod ON ProductKey = ProductID LEFT JOIN terr ON SalesTerritoryKey = TerritoryID) t"


def dash(spark, d):
    return gold.sales_dashboard(star(spark, d))


def named(df, **names):
    """Measures under short names, without blanks."""
    return df.select(*[c for c in df.columns if c not in names.values()], *[F.col(f"`{old}`").alias(new) for new, old in names.items()])


@query(f"""SELECT Region, CAST(sum(Revenue) AS DOUBLE) AS revenue, CAST(sum(ProductCost) AS DOUBLE) AS cost, CAST(sum(Profit) AS DOUBLE) AS profit, CAST(sum(FreightCost) AS DOUBLE) AS freight, CAST(sum(Tax) AS DOUBLE) AS tax,
 CAST(sum(OrderQuantity) AS BIGINT) AS units FROM {DASH} GROUP BY 1""")
def m_base_sums(spark, d):
    names = {"revenue": "Total Revenue", "cost": "Total Cost", "profit": "Total Profit", "freight": "Total Freight Cost", "tax": "Total Tax", "units": "Total Units Sold"}
    return named(m.evaluate(dash(spark, d), ["Region"], list(names.values())), **names)


@query(f"SELECT Region, count(DISTINCT OrderNumber) AS orders, count(DISTINCT CustomerKey) AS customers, count(DISTINCT ProductKey) AS products, count(DISTINCT Region) AS territories FROM {DASH} GROUP BY 1")
def m_distinct_counts(spark, d):
    names = {"orders": "Total Orders", "customers": "Total Customers", "products": "Total Products Sold", "territories": "Territory Count"}
    return named(m.evaluate(dash(spark, d), ["Region"], list(names.values())), **names)


@query(f"""SELECT Region, p / r AS margin, c / r AS cost_ratio, r / days AS per_day, r / o AS aov, r / u AS per_unit, r / k AS per_customer, CAST(o AS DOUBLE) / k AS orders_per_customer FROM (
 SELECT Region, CAST(sum(Revenue) AS DOUBLE) AS r, CAST(sum(ProductCost) AS DOUBLE) AS c, CAST(sum(Profit) AS DOUBLE) AS p, count(DISTINCT OrderDateKey) AS days, count(DISTINCT OrderNumber) AS o, CAST(sum(OrderQuantity) AS DOUBLE) AS u,
 count(DISTINCT CustomerKey) AS k FROM {DASH} GROUP BY 1)""")
def m_ratios(spark, d):
    names = {"margin": "Profit Margin %", "cost_ratio": "Cost Ratio %", "per_day": "Gross Revenue per Day", "aov": "Avg Order Value", "per_unit": "Avg Revenue per Unit", "per_customer": "Avg Revenue per Customer", "orders_per_customer": "Avg Orders per Customer"}
    return named(m.evaluate(dash(spark, d), ["Region"], list(names.values())), **names)


@query(f"""SELECT Region, (SELECT count(*) FROM hv) AS hv_count, CAST(sum(CASE WHEN k IS NOT NULL THEN Revenue END) AS DOUBLE) AS hv_revenue,
 CAST(sum(CASE WHEN k IS NOT NULL THEN Revenue END) AS DOUBLE) / CAST(sum(Revenue) AS DOUBLE) AS concentration FROM {DASH} LEFT JOIN hv ON k = CustomerKey GROUP BY 1""".replace("SELECT Region", "SELECT Region", 1))
def m_filtered_hvc(spark, d):
    s = star(spark, d)
    life = gold.customer_360(s).select("CustomerID", (F.col("LifetimeRevenue") >= 2_000_000).alias("HighValueCustomer"))
    return named(m.high_value(gold.sales_dashboard(s), life, ["Region"]), hv_count="High Value Customer Count", hv_revenue="High Value Customer Revenue", concentration="Customer Revenue Concentration %")


ORACLE["m_filtered_hvc"] = ORACLE["m_filtered_hvc"].replace("WITH \nsales AS", "WITH \nsales AS", 1).replace("\nSELECT Region, (SELECT", ", hv AS (SELECT CustomerKey AS k FROM sales GROUP BY 1 HAVING sum(Revenue) >= 2000000)\nSELECT Region, (SELECT", 1)


@query(f"""SELECT a.Region, a.age, b.margin FROM (SELECT Region, CAST(sum(18 + CustomerKey % 60) AS DOUBLE) / count(*) AS age FROM (SELECT DISTINCT Region, CustomerKey FROM {DASH}) GROUP BY 1) a
 JOIN (SELECT Region, round(avg(x), 9) AS margin FROM (SELECT Region, CAST(sum(Profit) AS DOUBLE) / CAST(sum(Revenue) AS DOUBLE) AS x FROM {DASH} GROUP BY Region, ProductKey) GROUP BY 1) b ON a.Region = b.Region""")
def m_avg_over_keys(spark, d):
    s = star(spark, d)
    rows = gold.sales_dashboard(s)
    both = m.on(["Region"], m.avg_customer_age(rows, s.customer, ["Region"]), m.avg_product_margin(rows, ["Region"]))
    out = named(both, age="Avg Customer Age", margin="Avg Product Profit Margin %")
    return out.withColumn("margin", F.round("margin", 9))


@query("""SELECT y, CAST(sum(CASE WHEN ever >= first THEN 1 ELSE 0 END) AS BIGINT) AS new_customers FROM (SELECT DISTINCT CAST(year(OrderDateKey) AS INTEGER) AS y, CustomerKey FROM sales)
 JOIN (SELECT CustomerKey, min(OrderDateKey) AS ever FROM sales GROUP BY 1) USING (CustomerKey) JOIN (SELECT CAST(year(OrderDateKey) AS INTEGER) AS y, min(OrderDateKey) AS first FROM sales GROUP BY 1) USING (y) GROUP BY 1""")
def m_new_customers(spark, d):
    return named(m.new_customers(dash(spark, d).withColumn("y", F.year("OrderDate")), ["y"]), new_customers="New Customers")


@query("""SELECT CAST(year(a.p) AS INTEGER) AS y, CAST(count(b.p) AS DOUBLE) / count(*) AS retention FROM (SELECT DISTINCT date_trunc('year', OrderDateKey) AS p, CustomerKey FROM sales) a
 LEFT JOIN (SELECT DISTINCT date_trunc('year', OrderDateKey) + INTERVAL 1 YEAR AS p, CustomerKey FROM sales) b ON a.p = b.p AND a.CustomerKey = b.CustomerKey GROUP BY 1""")
def m_retention(spark, d):
    out = m.retention(dash(spark, d).withColumn("p0", F.trunc("OrderDate", "year")), "p0")
    return out.select(F.year("p0").alias("y"), F.col("`Customer Retention Rate %`").alias("retention"))


@query("SELECT y, CAST(count(CASE WHEN n > 1 THEN 1 END) AS DOUBLE) / count(*) AS repeat_rate FROM (SELECT CAST(year(OrderDateKey) AS INTEGER) AS y, CustomerKey, count(DISTINCT OrderNumber) AS n FROM sales GROUP BY 1, 2) GROUP BY 1")
def m_repeat_rate(spark, d):
    return named(m.repeat_rate(dash(spark, d).withColumn("y", F.year("OrderDate")), ["y"]), repeat_rate="Repeat Customer Rate %")


@query(f"SELECT Region, CAST(sum(Revenue) AS DOUBLE) / CAST(sum(sum(Revenue)) OVER () AS DOUBLE) AS share FROM {DASH} GROUP BY 1")
def m_share_of_total(spark, d):
    return named(m.share_of_total(dash(spark, d), ["Region"], "Region", "Territory Revenue %", F.sum("Revenue")), share="Territory Revenue %")


@query(f"""SELECT Region, CAST(sum(CASE WHEN k <= 10 THEN r END) AS DOUBLE) AS top10, CAST(sum(CASE WHEN k <= 10 THEN r END) AS DOUBLE) / CAST(sum(r) AS DOUBLE) AS top10_share
 FROM (SELECT Region, ProductKey, sum(Revenue) AS r, rank() OVER (PARTITION BY Region ORDER BY sum(Revenue) DESC) AS k FROM {DASH} GROUP BY 1, 2) GROUP BY 1""")
def m_topn(spark, d):
    return named(m.top_n_revenue(dash(spark, d), ["Region"], "ProductID", 10, "top"), top10="top", top10_share="top share")


@query(f"""SELECT CAST(sum(CASE WHEN k <= 10 THEN r END) AS DOUBLE) AS top10, CAST(sum(CASE WHEN k <= 10 THEN r END) AS DOUBLE) / CAST(sum(r) AS DOUBLE) AS top10_share
 FROM (SELECT ProductKey, sum(Revenue) AS r, rank() OVER (ORDER BY sum(Revenue) DESC) AS k FROM {DASH} GROUP BY 1)""")
def m_topn_overall(spark, d):
    return named(m.top_n_revenue(dash(spark, d), [], "ProductID", 10, "top"), top10="top", top10_share="top share")


@query(f"""SELECT Region, CASE WHEN count(*) = 1 THEN max(Country) END AS top_country FROM (SELECT Region, Country, rank() OVER (PARTITION BY Region ORDER BY sum(Revenue) DESC) AS k FROM {DASH} GROUP BY 1, 2) WHERE k = 1 GROUP BY 1""")
def m_top_name(spark, d):
    return m.top_name(dash(spark, d), ["Region"], "Country", "top_country")


@query(f"SELECT Country, CAST(dense_rank() OVER (ORDER BY sum(Revenue) DESC) AS INTEGER) AS place FROM {DASH} GROUP BY 1")
def m_dense_rank(spark, d):
    return named(m.dense_revenue_rank(dash(spark, d), "Country"), place="Territory Revenue Rank")


RUNNING = "SELECT OrderDateKey AS OrderDate, CAST(sum(sum({0})) OVER (PARTITION BY date_trunc('{1}', OrderDateKey) ORDER BY OrderDateKey) AS DOUBLE) AS {2} FROM sales GROUP BY 1"


@query(f"SELECT * FROM ({RUNNING.format('Revenue', 'year', 'ytd')}) JOIN ({RUNNING.format('Profit', 'year', 'profit_ytd')}) USING (OrderDate)", dates=("OrderDate",))
def m_ytd(spark, d):
    return named(m.to_date(dash(spark, d)).select("OrderDate", "Revenue YTD", "Profit YTD"), ytd="Revenue YTD", profit_ytd="Profit YTD")


@query(RUNNING.format("Revenue", "quarter", "qtd"), dates=("OrderDate",))
def m_qtd(spark, d):
    return named(m.to_date(dash(spark, d)).select("OrderDate", "Revenue QTD"), qtd="Revenue QTD")


@query(RUNNING.format("Revenue", "month", "mtd"), dates=("OrderDate",))
def m_mtd(spark, d):
    return named(m.to_date(dash(spark, d)).select("OrderDate", "Revenue MTD"), mtd="Revenue MTD")


MONTHS = """(SELECT CAST(date_trunc('month', OrderDateKey) AS DATE) AS Month, CAST(sum(Revenue) AS DOUBLE) AS r, CAST(sum(Profit) AS DOUBLE) AS p, count(DISTINCT OrderNumber) AS o, count(DISTINCT CustomerKey) AS c FROM sales GROUP BY 1)"""


@query(f"SELECT a.Month, b.r AS revenue_py, b.p AS profit_py FROM {MONTHS} a LEFT JOIN {MONTHS} b ON a.Month = b.Month + INTERVAL 1 YEAR", dates=("Month",))
def m_prior_year(spark, d):
    return m.prior_year(dash(spark, d)).select("Month", F.col("Revenue PY").alias("revenue_py"), F.col("Profit PY").alias("profit_py"))


@query("""SELECT a.OrderDate, a.ytd, b.ly, (a.ytd - b.ly) / b.ly AS change FROM (SELECT OrderDateKey AS OrderDate, CAST(sum(sum(Revenue)) OVER (PARTITION BY date_trunc('year', OrderDateKey) ORDER BY OrderDateKey) AS DOUBLE) AS ytd FROM sales GROUP BY 1) a
 LEFT JOIN (SELECT o.d, CAST(sum(s.r) AS DOUBLE) AS ly FROM (SELECT DISTINCT OrderDateKey AS d FROM sales) o JOIN (SELECT OrderDateKey AS x, sum(Revenue) AS r FROM sales GROUP BY 1) s
 ON s.x <= o.d - INTERVAL 1 YEAR AND s.x >= date_trunc('year', o.d - INTERVAL 1 YEAR) GROUP BY 1) b ON a.OrderDate = b.d""", dates=("OrderDate",))
def m_py_ytd(spark, d):
    out = m.year_to_date_prior(dash(spark, d)).drop("Revenue PYTD")
    return named(out, ytd="Revenue YTD", ly="Revenue LY YTD", change="Revenue YTD vs PYTD %").withColumn("change", F.when(F.col("ly").isNotNull(), F.col("change")))


@query(f"""SELECT a.Month, a.r - coalesce(b.r, 0) AS variance, (a.r - b.r) / b.r AS yoy, (a.p - b.p) / b.p AS profit_yoy, a.p / a.r - coalesce(b.p / b.r, 0) AS margin_variance, CAST(a.o - b.o AS DOUBLE) / b.o AS orders_yoy,
 CAST(a.c - b.c AS DOUBLE) / b.c AS customers_yoy, (a.r / a.o - b.r / b.o) / (b.r / b.o) AS per_order_yoy FROM {MONTHS} a LEFT JOIN {MONTHS} b ON a.Month = b.Month + INTERVAL 1 YEAR""", dates=("Month",))
def m_yoy(spark, d):
    out = m.prior_year(dash(spark, d)).drop("Revenue PY", "Profit PY", "YoY Growth Trend")
    return named(out, variance="Revenue YoY Variance", yoy="Revenue YoY %", profit_yoy="Profit YoY %", margin_variance="Profit Margin YoY Variance", orders_yoy="Orders YoY %", customers_yoy="Customers YoY %", per_order_yoy="Revenue per Order YoY %")


@query(f"SELECT a.Month, a.r - coalesce(b.r, 0) AS variance, (a.r - b.r) / b.r AS mom FROM {MONTHS} a LEFT JOIN {MONTHS} b ON a.Month = b.Month + INTERVAL 1 MONTH", dates=("Month",))
def m_mom(spark, d):
    return named(m.month_over_month(dash(spark, d)), variance="MoM Revenue Variance", mom="MoM Revenue %")


ROLL = """SELECT Month, CAST(sum(r) OVER (ORDER BY n RANGE BETWEEN {0} PRECEDING AND CURRENT ROW) AS DOUBLE) AS rolling FROM
 (SELECT CAST(date_trunc('month', OrderDateKey) AS DATE) AS Month, year(OrderDateKey) * 12 + month(OrderDateKey) AS n, sum(Revenue) AS r FROM sales GROUP BY 1, 2)"""


@query(ROLL.format(2), dates=("Month",))
def m_rolling_3m(spark, d):
    return m.rolling_by_month(dash(spark, d), 3, "rolling")


@query(ROLL.format(11), dates=("Month",))
def m_rolling_12m(spark, d):
    return m.rolling_by_month(dash(spark, d), 12, "rolling")


BASE = "(SELECT OrderDateKey AS x, CAST(sum(Revenue) AS DECIMAL(18,2)) AS r FROM sales GROUP BY 1), (SELECT max(OrderDateKey) AS last FROM sales)"


@query(f"""SELECT f3, f6, total - f3 / 3 AS variance FROM (SELECT CAST(sum(r) AS DOUBLE) / count(*) * 3 AS f3 FROM {BASE} WHERE x > last - INTERVAL 3 MONTH), (SELECT CAST(sum(r) AS DOUBLE) / count(*) * 6 AS f6 FROM {BASE} WHERE x > last - INTERVAL 6 MONTH),
 (SELECT CAST(sum(Revenue) AS DOUBLE) AS total FROM sales)""")
def m_forecast(spark, d):
    s = star(spark, d)
    out = m.forecasts(gold.sales_forecasting_base(s), gold.sales_dashboard(s)).drop("Revenue Run Rate (Annual)")
    return named(out, f3="Revenue Forecast 3M", f6="Revenue Forecast 6M", variance="Forecast vs Actual Variance")


@query(f"SELECT CAST(sum(r) AS DOUBLE) / count(*) * 365 AS run_rate FROM {BASE} WHERE x > last - INTERVAL 365 DAY")
def m_run_rate(spark, d):
    s = star(spark, d)
    return m.forecasts(gold.sales_forecasting_base(s), gold.sales_dashboard(s)).select(F.col("Revenue Run Rate (Annual)").alias("run_rate"))


@query(f"""SELECT a.Month, CASE WHEN b.r IS NULL THEN 'No Prior Year Data' WHEN a.r > b.r THEN 'Growing' WHEN a.r < b.r THEN 'Declining' ELSE 'Flat' END AS trend
 FROM {MONTHS} a LEFT JOIN {MONTHS} b ON a.Month = b.Month + INTERVAL 1 YEAR""", dates=("Month",))
def m_trend_label(spark, d):
    return m.prior_year(dash(spark, d)).select("Month", F.col("YoY Growth Trend").alias("trend"))


@query("""SELECT 'all' AS context, CAST(sum(Revenue) AS DOUBLE) AS revenue, CAST(sum(Profit) AS DOUBLE) AS profit, CAST(sum(Profit) AS DOUBLE) / CAST(sum(Revenue) AS DOUBLE) AS margin FROM sales UNION ALL
 SELECT 'dates' AS context, CAST(sum(Revenue) AS DOUBLE), CAST(sum(Profit) AS DOUBLE), CAST(sum(Profit) AS DOUBLE) / CAST(sum(Revenue) AS DOUBLE) FROM sales WHERE OrderDateKey >= (SELECT date_trunc('year', max(OrderDateKey)) FROM sales)""")
def m_exec_kpi(spark, d):
    rows = dash(spark, d)
    both = m.executive_kpis(rows, False).withColumn("context", F.lit("all")).unionByName(m.executive_kpis(rows, True).withColumn("context", F.lit("dates")))
    return named(both, revenue="Executive Revenue KPI", profit="Executive Profit KPI", margin="Executive Margin KPI")


@query("""SELECT CAST(y AS INTEGER) AS y, CAST(q AS INTEGER) AS q, CAST(m AS INTEGER) AS m, CAST(dd AS INTEGER) AS dd, CAST(sum(Revenue) AS DOUBLE) AS revenue, CAST(grouping_id(y, q, m, dd) AS INTEGER) AS level
 FROM (SELECT year(OrderDateKey) AS y, quarter(OrderDateKey) AS q, month(OrderDateKey) AS m, day(OrderDateKey) AS dd, Revenue FROM sales) GROUP BY ROLLUP (y, q, m, dd)""")
def m_date_hierarchy(spark, d):
    return m.date_hierarchy(dash(spark, d))

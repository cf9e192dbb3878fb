"""Views, functions and procedures of the sales database as parameterised Spark SQL over DataFrames.

Tables enter as DataFrames and parameters as bound values, so nothing is registered and nothing is pasted into SQL.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame


def vw_customer_360(customer: DataFrame, territory: DataFrame) -> DataFrame:
    q = "SELECT c.*, t.territory_name, t.country, t.region FROM {customer} c LEFT JOIN {territory} t ON c.territory_key = t.territory_key"
    return customer.sparkSession.sql(q, customer=customer, territory=territory)


def vw_monthly_sales(sales: DataFrame, day: DataFrame, territory: DataFrame) -> DataFrame:
    q = """
    SELECT d.year, d.month, d.month_name, t.territory_name, t.country, count(DISTINCT s.sales_order_key) AS order_count, sum(s.order_quantity) AS total_units_sold,
           CAST(sum(s.sales_amount) AS DOUBLE) AS total_sales_amount, CAST(sum(s.tax_amount) AS DOUBLE) AS total_tax, CAST(sum(s.sales_amount) AS DOUBLE) / count(s.sales_amount) AS avg_order_value
    FROM {sales} s JOIN {day} d ON s.order_date_key = d.date_key JOIN {territory} t ON s.territory_key = t.territory_key
    GROUP BY ALL"""
    return sales.sparkSession.sql(q, sales=sales, day=day, territory=territory)


def vw_territory_performance(sales: DataFrame, territory: DataFrame) -> DataFrame:
    q = """
    SELECT t.territory_key, t.territory_name, t.country, t.region, count(DISTINCT s.sales_order_key) AS total_orders, count(DISTINCT s.customer_key) AS unique_customers,
           CAST(sum(s.sales_amount) AS DOUBLE) AS total_revenue, CAST(sum(s.sales_amount) AS DOUBLE) / count(s.sales_amount) AS avg_order_value
    FROM {sales} s JOIN {territory} t ON s.territory_key = t.territory_key GROUP BY ALL"""
    return sales.sparkSession.sql(q, sales=sales, territory=territory)


def vw_product_sales(sales: DataFrame, product: DataFrame) -> DataFrame:
    q = """
    SELECT p.product_key, p.product_name, p.category, p.subcategory, sum(s.order_quantity) AS total_units_sold, CAST(sum(s.sales_amount) AS DOUBLE) AS total_revenue,
           CAST(sum(s.unit_price) AS DOUBLE) / count(s.unit_price) AS avg_unit_price
    FROM {sales} s JOIN {product} p ON s.product_key = p.product_key GROUP BY ALL"""
    return sales.sparkSession.sql(q, sales=sales, product=product)


def fn_customer_lifetime_value(sales: DataFrame, customers: DataFrame) -> DataFrame:
    """The scalar function for every customer; 0 for those without a sale."""
    q = """
    SELECT c.customer_key, CAST(coalesce((SELECT sum(s.sales_amount) FROM {sales} s WHERE s.customer_key = c.customer_key), 0) AS DOUBLE) AS lifetime_value
    FROM {customers} c"""
    return sales.sparkSession.sql(q, sales=sales, customers=customers)


def fn_sales_by_date_range(sales: DataFrame, start: date, end: date) -> DataFrame:
    """The table function: sales of the days from ``start`` to ``end``, both included."""
    q = "SELECT s.* FROM {sales} s WHERE s.order_date_key BETWEEN :start AND :end"
    return sales.sparkSession.sql(q, args={"start": start, "end": end}, sales=sales)


def fn_discount_percentage(prices: DataFrame) -> DataFrame:
    """``prices`` with ``discount_pct`` of the list price; 0 where that is null or 0."""
    q = """
    SELECT p.*, CASE WHEN p.list_price IS NULL OR p.list_price = 0 THEN 0.0D
                     ELSE round(CAST(p.list_price - p.sale_price AS DOUBLE) / CAST(p.list_price AS DOUBLE) * 100, 2) END AS discount_pct
    FROM {prices} p"""
    return prices.sparkSession.sql(q, prices=prices)


def usp_customer_orders(sales: DataFrame, day: DataFrame, customer_key: int, start: date | None = None, end: date | None = None) -> DataFrame:
    """Orders of a customer, latest first; a bound that isn't given doesn't apply."""
    q = """
    SELECT s.sales_order_key, d.full_date, s.product_key, s.order_quantity, CAST(s.sales_amount AS DOUBLE) AS sales_amount
    FROM {sales} s JOIN {day} d ON s.order_date_key = d.date_key
    WHERE s.customer_key = :customer AND (:start IS NULL OR d.full_date >= :start) AND (:end IS NULL OR d.full_date <= :end)
    ORDER BY d.full_date DESC, s.sales_order_key, s.product_key"""
    return sales.sparkSession.sql(q, args={"customer": customer_key, "start": start, "end": end}, sales=sales, day=day)


def usp_territory_summary(sales: DataFrame, day: DataFrame, territory: DataFrame, year: int) -> DataFrame:
    q = """
    SELECT t.territory_name, t.country, count(DISTINCT s.sales_order_key) AS total_orders, CAST(sum(s.sales_amount) AS DOUBLE) AS total_revenue
    FROM {sales} s JOIN {day} d ON s.order_date_key = d.date_key JOIN {territory} t ON s.territory_key = t.territory_key
    WHERE d.year = :year GROUP BY ALL"""
    return sales.sparkSession.sql(q, args={"year": year}, sales=sales, day=day, territory=territory)


def usp_top_products(sales: DataFrame, day: DataFrame, product: DataFrame, n: int = 10, start: date | None = None) -> DataFrame:
    """The ``n`` products of the most revenue since ``start``; equal revenues by key."""
    q = """
    SELECT p.product_key, p.product_name, sum(s.order_quantity) AS total_units, CAST(sum(s.sales_amount) AS DOUBLE) AS total_revenue
    FROM {sales} s JOIN {product} p ON s.product_key = p.product_key JOIN {day} d ON s.order_date_key = d.date_key
    WHERE :start IS NULL OR d.full_date >= :start
    GROUP BY p.product_key, p.product_name ORDER BY sum(s.sales_amount) DESC, p.product_key LIMIT :n"""
    return sales.sparkSession.sql(q, args={"n": n, "start": start}, sales=sales, day=day, product=product)

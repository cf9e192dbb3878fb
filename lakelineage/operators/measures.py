"""Business measures over the sales dashboard: all 65, by archetype.

A measure is evaluated in a context: the rows of a filtered dashboard, grouped by some columns. Measures that are plain
functions of aggregates are kept by name in MEASURES and evaluated together, in one aggregation. Those that leave their
context (totals over all groups, other periods, top n, first orders) are functions of the dashboard and the grouping.
Blank is null: a ratio with a null or zero denominator is null; in a sum or difference a null counts as 0 unless both
sides are null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakelineage.functions.lineage import cut, ranked


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def minus(a: Column, b: Column) -> Column:
    zero = F.lit(0)
    return F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, zero) - F.coalesce(b, zero))


def total(c: str) -> Column:
    return F.sum(c).cast("double")


def distinct(c: str) -> Column:
    """Distinct values; null counts as one of them."""
    return F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))


def revenue() -> Column:
    return total("Revenue")


def profit() -> Column:
    return total("Profit")


#: Measures that are functions of aggregates.
MEASURES: dict[str, Callable[[], Column]] = {
    "Total Revenue": revenue,
    "Total Cost": lambda: total("ProductCost"),
    "Total Profit": profit,
    "Total Freight Cost": lambda: total("FreightCost"),
    "Total Tax": lambda: total("Tax"),
    "Total Units Sold": lambda: F.sum("OrderQuantity"),
    "Total Orders": lambda: distinct("OrderNumber"),
    "Total Customers": lambda: distinct("CustomerID"),
    "Total Products Sold": lambda: distinct("ProductID"),
    "Territory Count": lambda: distinct("Region"),
    "Profit Margin %": lambda: ratio(profit(), revenue()),
    "Product Profit Margin %": lambda: ratio(profit(), revenue()),
    "Cost Ratio %": lambda: ratio(total("ProductCost"), revenue()),
    "Gross Revenue per Day": lambda: ratio(revenue(), distinct("OrderDate")),
    "Avg Order Value": lambda: ratio(revenue(), distinct("OrderNumber")),
    "Avg Revenue per Unit": lambda: ratio(revenue(), F.sum("OrderQuantity")),
    "Revenue per Unit by Product": lambda: ratio(revenue(), F.sum("OrderQuantity")),
    "Avg Revenue per Customer": lambda: ratio(revenue(), distinct("CustomerID")),
    "Avg Orders per Customer": lambda: ratio(distinct("OrderNumber"), distinct("CustomerID")),
}


def evaluate(rows: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(*[MEASURES[n]().alias(n) for n in names])


def on(keys: list[str], a: DataFrame, b: DataFrame, how: str = "left") -> DataFrame:
    """Join on keys that may be null; without keys both have one row."""
    if not keys:
        return a.crossJoin(b)
    other = b.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return a.join(other, same, how).drop(*[f"_{k}" for k in keys])


# --- filters through a relationship, iterators, cohorts ---


def high_value(rows: DataFrame, customers: DataFrame, by: list[str]) -> DataFrame:
    """High Value Customer Count / Revenue and Customer Revenue Concentration %. ``customers``: CustomerID, HighValueCustomer.

    The count is over ``customers``, whom the dashboard's groups don't filter; the revenue is of their sales.
    """
    chosen = customers.where("HighValueCustomer").select("CustomerID").distinct()
    marked = rows.join(chosen.withColumn("_high", F.lit(True)), "CustomerID", "left")
    out = marked.groupBy(*by).agg(revenue().alias("_all"), F.sum(F.when(F.col("_high"), F.col("Revenue"))).cast("double").alias("High Value Customer Revenue"))
    out = out.withColumn("Customer Revenue Concentration %", ratio(F.col("High Value Customer Revenue"), F.col("_all"))).drop("_all")
    return out.crossJoin(chosen.agg(F.count("*").alias("High Value Customer Count")))  # one row


def avg_customer_age(rows: DataFrame, customers: DataFrame, by: list[str]) -> DataFrame:
    ages = customers.groupBy("CustomerID").agg(F.max("Age").alias("Age"))
    each = rows.select(*by, "CustomerID").distinct().join(ages, "CustomerID", "left")
    return each.groupBy(*by).agg(F.avg("Age").alias("Avg Customer Age"))


def avg_product_margin(rows: DataFrame, by: list[str]) -> DataFrame:
    each = rows.groupBy(*by, "ProductID").agg(ratio(profit(), revenue()).alias("_m"))
    return each.groupBy(*by).agg(F.avg("_m").alias("Avg Product Profit Margin %"))


def new_customers(rows: DataFrame, by: list[str]) -> DataFrame:
    """Customers of a group whose first order ever isn't before the group's first day."""
    ever = rows.groupBy("CustomerID").agg(F.min("OrderDate").alias("_ever"))
    first = rows.groupBy(*by).agg(F.min("OrderDate").alias("_first"))
    each = on(["CustomerID"], rows.select(*dict.fromkeys([*by, "CustomerID"])).distinct(), ever)
    return on(by, each, first).groupBy(*by).agg(F.sum((F.col("_ever") >= F.col("_first")).cast("long")).alias("New Customers"))


def retention(rows: DataFrame, period: str, months: int = 12) -> DataFrame:
    """Customer Retention Rate % by a period column that starts on ``period`` (a date, the first of a year or month)."""
    each = rows.select(F.col(period).alias("p"), "CustomerID").distinct()
    before = each.select(F.add_months("p", months).alias("p"), "CustomerID").withColumn("_was", F.lit(1))
    both = each.join(before, ["p", "CustomerID"], "left")
    return both.groupBy(F.col("p").alias(period)).agg(ratio(F.count("_was"), F.count("*")).alias("Customer Retention Rate %"))


def repeat_rate(rows: DataFrame, by: list[str]) -> DataFrame:
    each = rows.groupBy(*dict.fromkeys([*by, "CustomerID"])).agg(F.count_distinct("OrderNumber").alias("_n"))
    return each.groupBy(*by).agg(ratio(F.count_if(F.col("_n") > 1), F.count("*")).alias("Repeat Customer Rate %"))


# --- shares, top n, ranks ---


def share_of_total(rows: DataFrame, by: list[str], over: str, name: str, value: Column | None = None) -> DataFrame:
    """A group's share of the groups that differ in ``over`` alone (Territory Revenue %, Segment Revenue Share %)."""
    rest = [c for c in by if c != over]
    return rows.groupBy(*by).agg((revenue() if value is None else value).alias("_v")).withColumn(name, ratio(F.col("_v"), F.sum("_v").over(Window.partitionBy(*rest)))).drop("_v")


def reaching(each: DataFrame, by: list[str], n: int) -> DataFrame:
    """``each`` (``by``, ``_r``) with ``_in``: whether a row is among the first ``n`` of its group by ``_r``, ties at the end included.

    The ``n``-th value of a group is found first: over all rows by a limit, of which each task keeps ``n``; within groups
    by a window of which Spark keeps ``n`` rows before the shuffle. Rows are then compared with it.
    """
    if not by:
        least = each.orderBy(F.desc_nulls_last("_r")).limit(n).agg(F.when(F.count("_r") == F.count("*"), F.min("_r")))
        return each.withColumn("_least", least.scalar()).withColumn("_in", F.coalesce(F.col("_r") >= F.col("_least"), F.col("_least").isNull())).drop("_least")
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last("_r")))
    least = each.withColumn("_nth", nth).where(F.col("_nth") <= n).groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(F.count("*").alias("_n"), F.min("_r").alias("_m"), F.count("_r").alias("_known"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    found = each.join(least, same).withColumn("_in", (F.col("_known") < F.col("_n")) | (F.col("_r") >= F.col("_m")))
    return found.drop("_n", "_m", "_known", *[f"_by_{c}" for c in by])


def top_n_revenue(rows: DataFrame, by: list[str], of: str, n: int, name: str) -> DataFrame:
    """Revenue of the ``n`` values of ``of`` with the most revenue, ties at the end included, and its share of all."""
    each = rows.groupBy(*by, of).agg(F.sum("Revenue").alias("_r"))
    top = F.sum(F.when(F.col("_in"), F.col("_r"))).cast("double")
    return reaching(each, by, n).groupBy(*by).agg(top.alias(name), ratio(top, F.sum("_r")).alias(f"{name} share"))


def top_name(rows: DataFrame, by: list[str], of: str, name: str) -> DataFrame:
    """The value of ``of`` with the most revenue; null if several have it."""
    each = rows.groupBy(*by, of).agg(F.sum("Revenue").alias("_r"))
    return reaching(each, by, 1).where("_in").groupBy(*by).agg(F.when(F.count("*") == 1, F.max(of)).alias(name))


def dense_revenue_rank(rows: DataFrame, of: str) -> DataFrame:
    """Territory Revenue Rank: dense, most revenue first."""
    each = cut(rows.groupBy(of).agg(F.sum("Revenue").alias("_r")))
    return ranked(each, "_r", "Territory Revenue Rank", dense=True).select(of, "Territory Revenue Rank")


# --- time ---


def daily(rows: DataFrame) -> DataFrame:
    """One row a day; the windows below run over days, not sales."""
    return rows.groupBy("OrderDate").agg(F.sum("Revenue").alias("Revenue"), F.sum("Profit").alias("Profit"))


def to_date(rows: DataFrame) -> DataFrame:
    """Revenue YTD, QTD, MTD and Profit YTD of every day."""
    running = lambda c, *parts: F.sum(c).over(Window.partitionBy(*parts).orderBy("OrderDate")).cast("double")
    y, q, m = F.trunc("OrderDate", "year"), F.trunc("OrderDate", "quarter"), F.trunc("OrderDate", "month")
    return daily(rows).select("OrderDate", running("Revenue", y).alias("Revenue YTD"), running("Revenue", q).alias("Revenue QTD"), running("Revenue", m).alias("Revenue MTD"), running("Profit", y).alias("Profit YTD"))


def year_to_date_prior(rows: DataFrame) -> DataFrame:
    """Revenue YTD, LY YTD (the same as PYTD) and YTD vs PYTD % of every day. The day a year before need have no sale."""
    days = to_date(rows).select("OrderDate", "Revenue YTD")
    now = days.withColumn("_before", F.add_months("OrderDate", -12)).withColumn("_year", F.trunc("_before", "year"))
    then = daily(rows).select(F.col("OrderDate").alias("_day"), F.col("Revenue").alias("_r"))
    # Running totals by day of the year, carried to days without sales: the last total at or before the day.
    upto = then.select(F.trunc("_day", "year").alias("_year"), F.col("_day"), F.sum("_r").over(Window.partitionBy(F.trunc("_day", "year")).orderBy("_day")).cast("double").alias("_total"))
    both = now.select("_year", F.col("_before").alias("_at"), "OrderDate", "Revenue YTD", F.lit(None).cast("double").alias("_total")).unionByName(
        upto.select("_year", F.col("_day").alias("_at"), F.lit(None).cast("date").alias("OrderDate"), F.lit(None).cast("double").alias("Revenue YTD"), "_total")
    )
    carried = F.last("_total", ignorenulls=True).over(Window.partitionBy("_year").orderBy("_at", F.col("OrderDate").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("Revenue LY YTD", carried).where(F.col("OrderDate").isNotNull())
    return out.select("OrderDate", "Revenue YTD", "Revenue LY YTD", F.col("Revenue LY YTD").alias("Revenue PYTD"), ratio(minus(F.col("Revenue YTD"), F.col("Revenue LY YTD")), F.col("Revenue LY YTD")).alias("Revenue YTD vs PYTD %"))


def by_month(rows: DataFrame) -> DataFrame:
    return evaluate(rows.withColumn("Month", F.trunc("OrderDate", "month")), ["Month"], ["Total Revenue", "Total Profit", "Total Orders", "Total Customers", "Profit Margin %", "Avg Order Value"])


def beside(months: DataFrame, back: int) -> DataFrame:
    """Each month beside the one ``back`` months before, whose columns end in ``before``."""
    then = months.select(F.add_months("Month", back).alias("Month"), *[F.col(c).alias(f"{c} before") for c in months.columns if c != "Month"])
    return months.join(then, "Month", "left")


def prior_year(rows: DataFrame) -> DataFrame:
    """Revenue PY, Profit PY and every year-over-year measure, by month."""
    m = beside(by_month(rows), 12)
    now, then = (lambda c: F.col(c)), (lambda c: F.col(f"{c} before"))
    change = lambda c: ratio(minus(now(c), then(c)), then(c))
    return m.select(
        "Month", then("Total Revenue").alias("Revenue PY"), then("Total Profit").alias("Profit PY"), minus(now("Total Revenue"), then("Total Revenue")).alias("Revenue YoY Variance"), change("Total Revenue").alias("Revenue YoY %"),
        change("Total Profit").alias("Profit YoY %"), minus(now("Profit Margin %"), then("Profit Margin %")).alias("Profit Margin YoY Variance"), change("Total Orders").alias("Orders YoY %"),
        change("Total Customers").alias("Customers YoY %"), change("Avg Order Value").alias("Revenue per Order YoY %"), trend(change("Total Revenue")).alias("YoY Growth Trend"),
    )


def trend(yoy: Column) -> Column:
    return F.when(yoy.isNull(), "No Prior Year Data").when(yoy > 0, "Growing").when(yoy < 0, "Declining").otherwise("Flat")


def month_over_month(rows: DataFrame) -> DataFrame:
    m = beside(by_month(rows), 1)
    variance = minus(F.col("Total Revenue"), F.col("Total Revenue before"))
    return m.select("Month", variance.alias("MoM Revenue Variance"), ratio(variance, F.col("Total Revenue before")).alias("MoM Revenue %"))


def rolling(rows: DataFrame, months: int, name: str) -> DataFrame:
    """Revenue of the ``months`` months that end on the last day of the context."""
    return _trailing(rows, F.add_months("_last", -months)).agg(F.sum("Revenue").cast("double").alias(name))


def rolling_by_month(rows: DataFrame, months: int, name: str) -> DataFrame:
    """The same for every month as context, over one row per month: a range of months."""
    m = rows.groupBy(F.trunc("OrderDate", "month").alias("Month")).agg(F.sum("Revenue").alias("_r"))
    number = F.year("Month") * 12 + F.month("Month")
    return m.select("Month", F.sum("_r").over(Window.orderBy(number).rangeBetween(-(months - 1), 0)).cast("double").alias(name))


def _trailing(days: DataFrame, start: Column, day: str = "OrderDate") -> DataFrame:
    last = days.agg(F.max(day).alias("_last"))
    return days.crossJoin(F.broadcast(last)).where((F.col(day) > start) & (F.col(day) <= F.col("_last")))  # one row


def forecasts(base: DataFrame, rows: DataFrame) -> DataFrame:
    """Revenue Forecast 3M and 6M, Run Rate (Annual) and Forecast vs Actual Variance. ``base``: Date, Revenue by day.

    The forecasts are the average of a day's revenue times 3, 6 and 365, as defined, although they are named by month.
    """
    average = lambda start, name, times: _trailing(base, start, "Date").agg((F.sum(F.col("Revenue").cast("decimal(18,2)")).cast("double") / F.count("Revenue") * times).alias(name))
    out = average(F.add_months("_last", -3), "Revenue Forecast 3M", 3).crossJoin(average(F.add_months("_last", -6), "Revenue Forecast 6M", 6))
    out = out.crossJoin(average(F.date_sub("_last", 365), "Revenue Run Rate (Annual)", 365)).crossJoin(rows.agg(revenue().alias("_all")))  # one row each
    return out.withColumn("Forecast vs Actual Variance", minus(F.col("_all"), F.col("Revenue Forecast 3M") / 3)).drop("_all")


def executive_kpis(rows: DataFrame, date_filtered: bool) -> DataFrame:
    """Executive Revenue, Profit and Margin KPI; year to date where dates are filtered, else over all."""
    if date_filtered:
        rows = _trailing(rows, F.date_sub(F.trunc("_last", "year"), 1))
    return rows.agg(revenue().alias("Executive Revenue KPI"), profit().alias("Executive Profit KPI"), ratio(profit(), revenue()).alias("Executive Margin KPI"))


def catalog_facts(catalog: DataFrame, filtered: DataFrame | None = None) -> DataFrame:
    """Last Refresh Date over the whole catalog, Total Record Count over the filtered one."""
    return catalog.agg(F.max("RefreshTimestamp").alias("Last Refresh Date")).crossJoin((filtered or catalog).agg(F.sum("RecordCount").alias("Total Record Count")))  # one row each


def date_hierarchy(rows: DataFrame) -> DataFrame:
    """Revenue at every level of Year > Quarter > Month > Day, one scan for all levels."""
    parts = {"y": F.year("OrderDate"), "q": F.quarter("OrderDate"), "m": F.month("OrderDate"), "dd": F.dayofmonth("OrderDate")}
    return rows.withColumns(parts).rollup(*parts).agg(revenue().alias("revenue"), F.grouping_id().cast("int").alias("level"))

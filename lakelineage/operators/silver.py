"""Bronze to silver: typed, renamed and derived columns of the five star tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Landing names and the names that replace them.
CUSTOMER_NAMES = {"CustomerKey": "CustomerID", "CustomerAlternateKey": "CustomerCode"}
PRODUCT_NAMES = {"ProductKey": "ProductID", "EnglishProductName": "ProductName"}
SALES_NAMES = {"SalesOrderNumber": "OrderNumber", "SalesAmount": "Revenue", "TaxAmt": "Tax", "Freight": "FreightCost", "TotalProductCost": "ProductCost"}
CALENDAR_NAMES = {"DateKey": "CalendarKey", "FullDateAlternateKey": "CalendarDate", "EnglishMonthName": "MonthName", "CalendarQuarter": "Quarter", "EnglishDayNameOfWeek": "DayName"}
TERRITORY_NAMES = {"SalesTerritoryKey": "TerritoryID", "SalesTerritoryCountry": "Country", "SalesTerritoryRegion": "Region", "SalesTerritoryGroup": "TerritoryGroup"}
# Strings that mean null, and the upper bounds of age groups.
SENTINELS = ("NULL", "N/A", "NA", "NONE", "")
AGE_GROUPS = ((18, 25), (26, 35), (36, 45), (46, 60))


def age_group(age: Column) -> Column:
    """Label of an age; null, under 18 and over 60 all fall into the last group."""
    label: Column = F.lit("60+")
    for low, high in reversed(AGE_GROUPS):
        label = F.when((age >= low) & (age <= high), F.lit(f"{low}-{high}")).otherwise(label)
    return label


def first_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row of each key: the first by ``order`` (by all columns if none is given), so that reruns agree."""
    order = order or tuple(F.col(c).asc_nulls_last() for c in df.columns if c not in keys and "map<" not in df.schema[c].dataType.simpleString())
    ranked = df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or (F.lit(0),)))))
    return ranked.where("_nth = 1").drop("_nth")


def null_sentinels(df: DataFrame) -> DataFrame:
    """Strings that mean null become null, in every string column."""
    clean = lambda c: F.when(~F.upper(F.trim(c)).isin(*SENTINELS), F.col(c))
    return df.withColumns({f.name: clean(f.name) for f in df.schema if isinstance(f.dataType, StringType)})


def customers(raw: DataFrame, as_of: Column | None = None) -> DataFrame:
    """``as_of``: the day that ages are of; today by default."""
    age = F.year(F.current_date() if as_of is None else as_of) - F.year("BirthDate")
    named = raw.withColumnsRenamed(CUSTOMER_NAMES).withColumn("FullName", F.concat_ws(" ", "FirstName", "LastName"))
    return first_of(named.withColumn("Age", age.cast("int")).withColumn("AgeGroup", age_group(F.col("Age"))), ["CustomerID"])


def products(raw: DataFrame) -> DataFrame:
    return first_of(null_sentinels(raw.withColumnsRenamed(PRODUCT_NAMES)), ["ProductID"])


def sales(raw: DataFrame) -> DataFrame:
    named = raw.withColumnsRenamed(SALES_NAMES)
    revenue, cost = F.col("Revenue").cast("double"), F.col("ProductCost").cast("double")
    profit = F.round(F.col("Revenue") - F.col("ProductCost"), 2).cast(named.schema["Revenue"].dataType)
    return named.withColumn("Profit", profit).withColumn("ProfitMargin", F.round(F.try_divide(revenue - cost, revenue) * 100, 2))


def calendar(raw: DataFrame) -> DataFrame:
    return raw.withColumnsRenamed(CALENDAR_NAMES).withColumn("YearMonth", F.date_format("CalendarDate", "yyyy-MM"))


def territories(raw: DataFrame) -> DataFrame:
    return raw.withColumnsRenamed(TERRITORY_NAMES)


def calendar_of(span: DataFrame) -> DataFrame:
    """Every day of the years of ``first`` to ``last``, with its parts: the calculated date table."""
    start, end = F.trunc("first", "year"), F.date_sub(F.add_months(F.trunc("last", "year"), 12), 1)
    days = span.select(F.explode(F.sequence(start, end)).alias("CalendarDate"))
    return days.select(
        F.col("CalendarDate").alias("CalendarKey"), "CalendarDate", F.year("CalendarDate").alias("CalendarYear"), F.quarter("CalendarDate").alias("Quarter"),
        F.month("CalendarDate").alias("MonthNumberOfYear"), F.date_format("CalendarDate", "MMMM").alias("MonthName"), F.date_format("CalendarDate", "yyyy-MM").alias("YearMonth"),
        F.concat(F.lit("Qtr "), F.quarter("CalendarDate")).alias("QuarterName"), F.dayofmonth("CalendarDate").alias("Day"),
    )

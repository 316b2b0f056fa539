"""Month-filtered sales measures of the dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_month(sales: DataFrame, year: int, month: int) -> DataFrame:
    """Rows of one month, as a range on the stored timestamp."""
    first = f"{year:04d}-{month:02d}-01"
    start = F.lit(first).cast("timestamp_ntz")
    end = F.add_months(F.lit(first).cast("date"), 1).cast("timestamp_ntz")
    return sales.filter((F.col("timestamp") >= start) & (F.col("timestamp") < end))


def revenue() -> Column:
    return F.col("units") * F.col("unit_price")


def dollars(value: Column) -> Column:
    """Fixed format: $1,234.50."""
    return F.concat(F.lit("$"), F.format_number(value, 2))


def kpis(sales: DataFrame, year: int, month: int) -> DataFrame:
    """Revenue, orders and average order value; zeros when the month is empty."""
    totals = in_month(sales, year, month).agg(
        F.coalesce(F.sum(revenue()), F.lit(0)).alias("exact"), F.count(F.lit(1)).alias("total_orders")
    )
    total_revenue = F.col("exact").cast("double")
    average = total_revenue / F.greatest(F.col("total_orders"), F.lit(1))
    return totals.select(
        total_revenue.alias("total_revenue"),
        "total_orders",
        average.alias("average_order_value"),
        dollars(total_revenue).alias("total_revenue_text"),
        dollars(average).alias("average_order_value_text"),
    )


def category_revenue(sales: DataFrame, year: int, month: int) -> DataFrame:
    return (
        in_month(sales, year, month)
        .groupBy("category")
        .agg(F.sum(revenue()).cast("double").alias("total_revenue"))
    )


def sales_trend(sales: DataFrame, year: int, month: int) -> DataFrame:
    """Revenue of each sale in date order."""
    return (
        in_month(sales, year, month)
        .select("timestamp", "order_id", "category", revenue().cast("double").alias("revenue"))
        .orderBy("timestamp", "order_id", "category", "revenue")
    )

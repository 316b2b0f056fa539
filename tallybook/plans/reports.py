"""Dashboard measures and business-report analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallybook.functions.numeric import amount_if, count_if, exact_sum, money, ratio
from tallybook.operators import dashboard
from tallybook.sources.retail import Retail
from tallybook.sources.tables import Tables

DASH_YEAR, DASH_MONTH = 2000, 8
CORE_REGIONS = ("AMERICA", "EUROPE")
DIGITS = 6
WORST_PER_CATEGORY = 3


def retail(spark: SparkSession, sf_dir: str) -> Retail:
    return Retail(Tables(spark, sf_dir))


def sales_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dashboard rows: one per order line."""
    t = Tables(spark, sf_dir)
    return (
        t["lineitem"]
        .join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("o_orderdate").alias("timestamp"),
            F.col("o_orderkey").alias("order_id"),
            F.col("p_type").alias("category"),
            F.col("l_quantity").cast("int").alias("units"),
            money("p_retailprice").alias("unit_price"),
        )
    )


def dash_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.kpis(sales_rows(spark, sf_dir), DASH_YEAR, DASH_MONTH)


def dash_category_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dashboard.category_revenue(sales_rows(spark, sf_dir), DASH_YEAR, DASH_MONTH)


def dash_sales_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    trend = dashboard.sales_trend(sales_rows(spark, sf_dir), DASH_YEAR, DASH_MONTH)
    return trend.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd"))


def order_headers(r: Retail) -> DataFrame:
    return r.t["orders"].select(
        F.col("o_orderkey").alias("ss_ticket_number"),
        F.col("o_custkey").alias("customer"),
        F.col("o_orderdate").alias("ordered"),
        F.date_format("o_orderdate", "yyyy-MM").alias("month"),
        F.col("o_orderpriority").alias("ship_mode"),
    )


def order_totals(r: Retail, cost: bool = True) -> DataFrame:
    """Lines summed per order before anything is joined to them."""
    lines = r.with_cost(r.lines()) if cost else r.lines()
    sums = [
        F.count(F.lit(1)).alias("lines"),
        count_if(F.col("is_return")).alias("returned_lines"),
        exact_sum("ss_ext_sales_price").alias("sales"),
        amount_if(F.col("is_return"), "ss_ext_sales_price").alias("lost"),
        exact_sum("net_loss").alias("shipping"),
    ]
    if cost:
        sums.append(exact_sum("ss_net_profit").alias("profit"))
    return lines.groupBy("ss_ticket_number").agg(*sums)


def orders_with_totals(r: Retail, cost: bool = True) -> DataFrame:
    return order_totals(r, cost).join(order_headers(r), "ss_ticket_number")


def people(r: Retail) -> DataFrame:
    """Customers with segment and region."""
    places = r.t["nation"].join(F.broadcast(r.t["region"]), F.col("n_regionkey") == F.col("r_regionkey"))
    return (
        r.t["customer"]
        .join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("c_custkey").alias("customer"), F.col("c_mktsegment").alias("segment"), F.col("r_name").alias("region"))
    )


def shown_sum(name: str) -> Column:
    """Sum of decimals, as a double."""
    return F.sum(name).cast("double")


def margin() -> Column:
    return ratio(F.sum("profit"), F.sum("sales"))


def return_rate() -> Column:
    return ratio(F.sum("returned_lines"), F.sum("lines"))


def bi_return_rate_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return rate of the last six months beside the rate of all months."""
    monthly = (
        orders_with_totals(retail(spark, sf_dir), cost=False)
        .groupBy("month")
        .agg(F.sum("lines").alias("lines"), F.sum("returned_lines").alias("returned_lines"))
    )
    overall = monthly.agg(return_rate().alias("historical_rate"))
    recent = monthly.orderBy(F.desc("month")).limit(6)
    rate = ratio(F.col("returned_lines"), F.col("lines"))
    return recent.join(F.broadcast(overall)).select(
        "month", rate.alias("return_rate"), "historical_rate", (rate - F.col("historical_rate")).alias("difference")
    )


def bi_revenue_lost_to_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of revenue returned, in total and per category."""
    r = retail(spark, sf_dir)
    per_item = r.lines().groupBy("ss_item_sk").agg(
        exact_sum("ss_ext_sales_price").alias("sales"), amount_if(F.col("is_return"), "ss_ext_sales_price").alias("lost")
    )
    return (
        per_item.join(r.item().select("i_item_sk", F.col("i_category").alias("category")), F.col("ss_item_sk") == F.col("i_item_sk"))
        .rollup("category")
        .agg(
            shown_sum("sales").alias("revenue"),
            F.coalesce(shown_sum("lost"), F.lit(0.0)).alias("lost_revenue"),
            (F.lit(100.0) * ratio(F.coalesce(F.sum("lost"), F.lit(0)), F.sum("sales"))).alias("lost_percent"),
        )
    )


def bi_margin_by_ship_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        orders_with_totals(retail(spark, sf_dir))
        .groupBy("ship_mode")
        .agg(shown_sum("sales").alias("sales"), shown_sum("profit").alias("profit"), margin().alias("profit_margin"))
    )


def bi_segment_returns_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-day orders of a customer against later ones, by region and segment."""
    r = retail(spark, sf_dir)
    first = order_headers(r).groupBy("customer").agg(F.min("ordered").alias("first_ordered"))
    kind = F.when(F.col("ordered") == F.col("first_ordered"), "New").otherwise("Returning")
    return (
        orders_with_totals(r)
        .join(people(r).join(first, "customer"), "customer")
        .groupBy(kind.alias("customer_kind"), "region", "segment")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            return_rate().alias("return_rate"),
            ratio(F.sum("profit"), F.count(F.lit(1))).alias("profit_per_order"),
            margin().alias("profit_margin"),
        )
    )


def bi_shipping_cost_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average shipping cost per order by month and its change."""
    by_month = (
        orders_with_totals(retail(spark, sf_dir), cost=False)
        .groupBy("month")
        .agg(F.count(F.lit(1)).alias("orders"), ratio(F.sum("shipping"), F.count(F.lit(1))).alias("cost_per_order"))
    )
    # One row per calendar month: the single window partition stays small.
    before = F.lag("cost_per_order").over(W.partitionBy(F.lit(0)).orderBy("month"))
    return by_month.withColumn("change", F.col("cost_per_order") - before)


def bi_purchase_frequency_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, orders per customer and margin by segment and month."""
    r = retail(spark, sf_dir)
    per_customer = (
        orders_with_totals(r)
        .groupBy("customer", "month")
        .agg(F.count(F.lit(1)).alias("orders"), F.sum("sales").alias("sales"), F.sum("profit").alias("profit"))
    )
    by_segment = (
        per_customer.join(people(r).select("customer", "segment"), "customer")
        .groupBy("segment", "month")
        .agg(
            F.count(F.lit(1)).alias("unique_customers"),
            ratio(F.sum("orders"), F.count(F.lit(1))).alias("orders_per_customer"),
            margin().alias("profit_margin"),
        )
    )
    before = F.lag("profit_margin").over(W.partitionBy("segment").orderBy("month"))
    return by_segment.withColumn("margin_shift", F.col("profit_margin") - before)


def bi_margin_erosion_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lowest-margin products of each category and their monthly volume."""
    r = retail(spark, sf_dir)
    per_item = r.with_cost(r.lines()).groupBy("ss_item_sk").agg(margin_of_lines().alias("profit_margin"))
    lowest = W.partitionBy("category").orderBy("profit_margin", "ss_item_sk")
    worst = (
        per_item.join(r.item().select("i_item_sk", F.col("i_category").alias("category")), F.col("ss_item_sk") == F.col("i_item_sk"))
        .withColumn("place", F.row_number().over(lowest))
        .filter(F.col("place") <= WORST_PER_CATEGORY)
        .select("ss_item_sk", "category", "place", "profit_margin")
    )
    return (
        r.lines()
        .join(worst, "ss_item_sk")
        .join(order_headers(r).select("ss_ticket_number", "month"), "ss_ticket_number")
        .groupBy("category", "place", F.col("ss_item_sk").alias("product"), "profit_margin", "month")
        .agg(F.sum("ss_quantity").alias("units"))
    )


def margin_of_lines() -> Column:
    return ratio(exact_sum("ss_net_profit"), exact_sum("ss_ext_sales_price"))


def bi_core_region_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margin of customers inside and outside the core regions."""
    r = retail(spark, sf_dir)
    per_customer = (
        orders_with_totals(r).groupBy("customer").agg(F.sum("sales").alias("sales"), F.sum("profit").alias("profit"))
    )
    group = F.when(F.col("region").isin(*CORE_REGIONS), "Core").otherwise("Non-core")
    return (
        per_customer.join(people(r), "customer")
        .groupBy(group.alias("region_group"))
        .agg(shown_sum("sales").alias("sales"), shown_sum("profit").alias("profit"), margin().alias("profit_margin"))
    )


def bi_yoy_month_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipping cost by month and mode beside the same month a year earlier."""
    cost = (
        orders_with_totals(retail(spark, sf_dir), cost=False)
        .groupBy(F.year("ordered").alias("year"), F.month("ordered").alias("month_number"), "ship_mode")
        .agg(shown_sum("shipping").alias("cost"))
    )
    earlier = cost.select((F.col("year") + 1).alias("year"), "month_number", "ship_mode", F.col("cost").alias("previous_cost"))
    return cost.join(earlier, ["year", "month_number", "ship_mode"], "left").withColumn(
        "growth", ratio(F.col("cost"), F.col("previous_cost"))
    )


def bi_discount_margin_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of line discount and line margin per segment."""
    r = retail(spark, sf_dir)
    discount = ratio(F.col("ss_coupon_amt"), F.col("ss_ext_list_price"))
    line_margin = ratio(F.col("ss_net_profit"), F.col("ss_ext_sales_price"))
    segments = order_headers(r).join(people(r), "customer").select("ss_ticket_number", "segment")
    return (
        r.with_cost(r.lines())
        .join(segments, "ss_ticket_number")
        .groupBy("segment")
        .agg(F.count(F.lit(1)).alias("lines"), F.round(F.corr(discount, line_margin), DIGITS).alias("correlation"))
    )


def bi_order_volume_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return rate and margin spread of customers by how many orders they placed."""
    per_customer = (
        orders_with_totals(retail(spark, sf_dir))
        .withColumn("order_margin", ratio(F.col("profit"), F.col("sales")))
        .groupBy("customer")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            return_rate().alias("rate"),
            F.stddev_samp("order_margin").alias("spread"),
        )
    )
    return per_customer.groupBy("orders").agg(
        F.count(F.lit(1)).alias("customers"),
        F.round(F.avg("rate"), DIGITS).alias("return_rate"),
        F.round(F.avg("spread"), DIGITS).alias("margin_volatility"),
    )


def bi_cohort_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margin of customers first seen in the last three months against the others."""
    r = retail(spark, sf_dir)
    per_customer = (
        orders_with_totals(r)
        .groupBy("customer")
        .agg(F.min("ordered").alias("first_ordered"), F.sum("sales").alias("sales"), F.sum("profit").alias("profit"), F.count(F.lit(1)).alias("orders"))
    )
    latest = order_headers(r).agg(F.add_months(F.max("ordered").cast("date"), -3).alias("cutoff"))
    cohort = F.when(F.col("first_ordered").cast("date") > F.col("cutoff"), "New").otherwise("Established")
    return (
        per_customer.join(F.broadcast(latest))
        .groupBy(cohort.alias("cohort"))
        .agg(F.count(F.lit(1)).alias("customers"), F.sum("orders").alias("orders"), margin().alias("profit_margin"))
    )


SUITE = {
    f.__name__: f
    for f in (
        dash_kpis, dash_category_revenue, dash_sales_trend, bi_return_rate_trend, bi_revenue_lost_to_returns,
        bi_margin_by_ship_mode, bi_segment_returns_margin, bi_shipping_cost_trend, bi_purchase_frequency_margin,
        bi_margin_erosion_products, bi_core_region_margin, bi_yoy_month_mode, bi_discount_margin_corr,
        bi_order_volume_volatility, bi_cohort_margin,
    )
}

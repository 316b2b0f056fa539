"""Star-schema views and the business questions asked of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions.numeric import AMOUNT_SCALE, in_currency, total
from tallybook.operators import star
from tallybook.operators.percentile import nearest_rank
from tallybook.sources.ecommerce import Ecommerce
from tallybook.sources.retail import day_range
from tallybook.sources.tables import Tables

RANKS = {"median": "0.5", "p95": "0.95", "p99": "0.99"}
CITY = "NATION_3"
AMOUNTS = ("price", "freight_value", "line_total", "total_payment_value")


def source(spark: SparkSession, sf_dir: str) -> Ecommerce:
    return Ecommerce(Tables(spark, sf_dir))


def plain(df: DataFrame) -> DataFrame:
    """Report form: amounts in currency as doubles, dates as ISO text."""

    def shown(name: str, kind: str):
        if name in AMOUNTS:
            value = F.col(name)
            return in_currency(value).cast("double") if kind.startswith("decimal") else value / AMOUNT_SCALE
        return F.col(name).cast("string") if kind == "date" else F.col(name)

    return df.select(*[shown(name, kind).alias(name) for name, kind in df.dtypes])


def sales(e: Ecommerce, payments: bool = False) -> DataFrame:
    return star.sales_fact(e.order_items(), e.orders(), e.customers(), e.order_payments() if payments else None)


def products(e: Ecommerce) -> DataFrame:
    return star.product_dimension(e.products(), e.translation())


def star_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(star.date_dimension(source(spark, sf_dir).dim_date()))


def star_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.customer_dimension(source(spark, sf_dir).customers())


def star_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return products(source(spark, sf_dir))


def star_sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.seller_dimension(source(spark, sf_dir).sellers())


def star_geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.geography_dimension(source(spark, sf_dir).geolocation())


def star_payments_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(star.payments_per_order(source(spark, sf_dir).order_payments()))


def star_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(sales(source(spark, sf_dir), payments=True))


def star_rowcounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = source(spark, sf_dir)
    return star.row_counts({
        "Sales": sales(e),
        "Date": star.date_dimension(e.dim_date()),
        "Customers": star.customer_dimension(e.customers()),
        "Products": products(e),
        "Sellers": star.seller_dimension(e.sellers()),
        "Geography": star.geography_dimension(e.geolocation()),
    })


def bq_category_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of categories whose name contains "furniture"."""
    e = source(spark, sf_dir)
    wanted = products(e).filter(F.col("product_category_english").like("%furniture%")).select("product_id")
    return e.order_items().join(wanted, "product_id").agg(total("price").alias("total_furniture_revenue"))


def bq_category_year_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of one category in one year."""
    e = source(spark, sf_dir)
    wanted = products(e).filter(F.col("product_category_english") == "health_beauty")
    # The year as a range on the stored timestamp reaches the scan of the orders.
    in_year = day_range("order_purchase_timestamp", "1997-01-01", "1997-12-31")
    return (
        star.sales_fact(e.order_items(), e.orders().filter(in_year), e.customers(), None)
        .join(wanted, "product_id")
        .groupBy(F.col("product_category_english").alias("product_category"))
        .agg(total("price").alias("total_revenue"))
    )


def bq_top_city_delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City with most delivered orders; ties go to the first name."""
    e = source(spark, sf_dir)
    people = star.customer_dimension(e.customers()).select("customer_id", "customer_city")
    delivered = sales(e).filter(F.col("is_delivered") == 1).select("order_id", "customer_id").distinct()
    return (
        delivered.join(people, "customer_id")
        .groupBy("customer_city")
        .agg(F.count_distinct("order_id").alias("delivered_order_count"))
        .orderBy(F.desc("delivered_order_count"), "customer_city")
        .limit(1)
    )


def bq_top_customer_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer with the highest payment sum.

    The order's payment counts once per item, as the published answer does.
    """
    e = source(spark, sf_dir)
    spent = sales(e, payments=True).groupBy("customer_id").agg(F.sum(in_currency(F.col("total_payment_value"))).alias("exact"))
    return (
        spent.join(star.customer_dimension(e.customers()), "customer_id")
        .orderBy(F.desc("exact"), "customer_id")
        .limit(1)
        .select(
            "customer_id", "customer_city", "customer_state", "customer_zip_code",
            F.col("exact").cast("double").alias("total_amount_spent"),
        )
    )


def delivery_stats(day_counts: DataFrame, key: str) -> DataFrame:
    """Count, average and nearest-rank percentiles from items per delivery day."""
    average = day_counts.groupBy(key).agg(
        F.sum("items").alias("n"),
        F.round(F.sum(F.col("items") * F.col("delivery_days")) / F.sum("items"), 2).alias("avg_days"),
    )
    ranks = nearest_rank(day_counts, [key], "delivery_days", RANKS, weight="items")
    return average.join(ranks, key).select(
        key, "n", "avg_days", *[F.col(name).cast("double").alias(f"{name}_days") for name in RANKS]
    )


def busiest(day_counts: DataFrame, key: str) -> DataFrame:
    """Key with most items: one row, so it may be broadcast."""
    items = day_counts.groupBy(key).agg(F.sum("items").alias("n"))
    return F.broadcast(items.orderBy(F.desc("n"), key).limit(1).select(key))


def bq_late_zip_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery days in the zip code with most late items."""
    day_counts = (
        sales(source(spark, sf_dir))
        .filter(F.col("delivery_days").isNotNull())
        .groupBy("customer_zip_code", "is_late", "delivery_days")
        .agg(F.count(F.lit(1)).alias("items"))
    )
    worst = busiest(day_counts.filter(F.col("is_late") == 1), "customer_zip_code")
    return delivery_stats(day_counts.join(worst, "customer_zip_code"), "customer_zip_code").withColumnsRenamed(
        {"customer_zip_code": "customer_zip", "n": "delivery_count"}
    )


def bq_top_city_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery days in the city with most deliveries."""
    e = source(spark, sf_dir)
    people = star.customer_dimension(e.customers()).select("customer_id", "customer_city")
    day_counts = (
        sales(e)
        .filter((F.col("is_delivered") == 1) & F.col("delivery_days").isNotNull())
        .join(people, "customer_id")
        .groupBy("customer_city", "delivery_days")
        .agg(F.count(F.lit(1)).alias("items"))
    )
    top = delivery_stats(day_counts.join(busiest(day_counts, "customer_city"), "customer_city"), "customer_city")
    return top.withColumnsRenamed({
        "n": "n_delivered_orders", "avg_days": "avg_delivery_days", "median_days": "median_delivery_days",
        "p95_days": "p95_delivery_days", "p99_days": "p99_delivery_days",
    })


def bq_median_of_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median over products of each product's median price, one category."""
    e = source(spark, sf_dir)
    wanted = products(e).filter(F.lower("product_category_english") == "health_beauty").select("product_id")
    cents = F.floor(F.col("price") / 100).alias("cents")
    prices = e.order_items().join(wanted, "product_id").select("product_id", cents)
    per_product = nearest_rank(prices, ["product_id"], "cents", {"median_cents": "0.5"})
    overall = nearest_rank(per_product.select("median_cents"), [], "median_cents", {"median": "0.5"})
    return overall.select((F.col("median").cast("decimal(18,0)") / 100).cast("double").alias("catalog_median_price"))


def bq_approved_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = source(spark, sf_dir).orders()
    return orders.filter(F.col("order_status") == "approved").agg(F.count(F.lit(1)).alias("approved_orders"))


def in_city(customers: DataFrame) -> DataFrame:
    return customers.filter(F.upper("customer_city") == CITY)


def bq_customers_in_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = in_city(source(spark, sf_dir).customers())
    return people.agg(F.count_distinct("customer_id").alias("customers"))


def bq_top3_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three cities with most customers; the name breaks ties."""
    return (
        source(spark, sf_dir).customers()
        .groupBy("customer_city")
        .agg(F.count_distinct("customer_id").alias("customers"))
        .orderBy(F.desc("customers"), "customer_city")
        .limit(3)
    )


def bq_top3_customers_in_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three customers of a city with most approved orders; none without any."""
    e = source(spark, sf_dir)
    approved = (
        e.orders().filter(F.col("order_status") == "approved").groupBy("customer_id").agg(F.count(F.lit(1)).alias("approved_orders"))
    )
    return (
        approved.join(in_city(e.customers()), "customer_id")
        .select("customer_id", "customer_city", "approved_orders")
        .orderBy(F.desc("approved_orders"), "customer_id")
        .limit(3)
    )


def unfulfilled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct customers with an undelivered order, per city."""
    e = source(spark, sf_dir)
    waiting = e.orders().filter(F.col("order_delivered_customer_date").isNull()).select("customer_id").distinct()
    return (
        waiting.join(e.customers().select("customer_id", "customer_city"), "customer_id")
        .groupBy("customer_city")
        .agg(F.count(F.lit(1)).alias("unfulfilled_customers"))
    )


def bq_unfulfilled_city(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unfulfilled(spark, sf_dir).orderBy(F.desc("unfulfilled_customers"), "customer_city").limit(1)


def bq_unfulfilled_city_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every city that shares the highest count."""
    cities = unfulfilled(spark, sf_dir)
    best = cities.agg(F.max("unfulfilled_customers").alias("unfulfilled_customers"))
    return cities.join(F.broadcast(best), "unfulfilled_customers").select("customer_city", "unfulfilled_customers")


def bq_unfulfilled_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = source(spark, sf_dir).orders()
    return orders.filter(F.col("order_delivered_customer_date").isNull()).agg(F.count(F.lit(1)).alias("unfulfilled_orders"))


SUITE = {
    f.__name__: f
    for f in (
        star_date, star_customers, star_products, star_sellers, star_geography, star_payments_agg, star_sales,
        star_rowcounts, bq_category_revenue, bq_category_year_revenue, bq_top_city_delivered, bq_top_customer_spend,
        bq_late_zip_percentiles, bq_top_city_percentiles, bq_median_of_medians, bq_approved_orders,
        bq_customers_in_city, bq_top3_cities, bq_top3_customers_in_city, bq_unfulfilled_city,
        bq_unfulfilled_city_ties, bq_unfulfilled_count,
    )
}

"""Star schema (one fact, five dimensions) over the e-commerce tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.numeric import exact_units, mean

MONTHS = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)
WEEKDAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")
DATE_COLUMNS = (
    "date_key", "date", "year", "quarter", "month_number", "month_name",
    "year_month", "day_of_month", "day_of_week", "day_name", "day_of_year", "is_weekend",
)


def date_dimension(dim_date: DataFrame) -> DataFrame:
    return dim_date.select(*DATE_COLUMNS)


def customer_dimension(customers: DataFrame) -> DataFrame:
    """One row per person: the row with the lowest customer id.

    ``min_by`` combines before the shuffle, unlike a row number per person.
    """
    kept = F.struct("customer_zip_code_prefix", "customer_city", "customer_state")
    first = customers.groupBy("customer_unique_id").agg(F.min_by(kept, "customer_id").alias("kept"))
    return first.select(
        F.col("customer_unique_id").alias("customer_id"),
        F.col("kept.customer_zip_code_prefix").alias("customer_zip_code"),
        F.upper("kept.customer_city").alias("customer_city"),
        F.upper("kept.customer_state").alias("customer_state"),
    )


def product_dimension(products: DataFrame, translation: DataFrame) -> DataFrame:
    return products.join(translation, "product_category_name", "left").select(
        "product_id",
        F.col("product_category_name").alias("product_category"),
        F.coalesce("product_category_name_english", "product_category_name").alias("product_category_english"),
        F.col("product_name_lenght").alias("product_name_length"),
        F.col("product_description_lenght").alias("product_description_length"),
        F.col("product_photos_qty").alias("product_photos_count"),
        "product_weight_g",
        "product_length_cm",
        "product_height_cm",
        "product_width_cm",
    )


def seller_dimension(sellers: DataFrame) -> DataFrame:
    return sellers.select(
        "seller_id",
        F.col("seller_zip_code_prefix").alias("seller_zip_code"),
        F.upper("seller_city").alias("seller_city"),
        F.upper("seller_state").alias("seller_state"),
    )


def geography_dimension(geolocation: DataFrame) -> DataFrame:
    return geolocation.groupBy(F.col("geolocation_zip_code_prefix").alias("zip_code")).agg(
        F.upper(F.max("geolocation_city")).alias("city"),
        F.upper(F.max("geolocation_state")).alias("state"),
        mean("geolocation_lat").alias("latitude"),
        mean("geolocation_lng").alias("longitude"),
    )


def payments_per_order(order_payments: DataFrame) -> DataFrame:
    return order_payments.groupBy("order_id").agg(
        exact_units("payment_value").alias("total_payment_value"),
        F.max("payment_installments").alias("payment_installments"),
        F.min("payment_type").alias("payment_type"),
    )


def date_key(stamp: str) -> Column:
    """Day as an integer yyyymmdd."""
    return F.year(stamp) * 10000 + F.month(stamp) * 100 + F.dayofmonth(stamp)


def month_name(stamp: str) -> Column:
    return F.element_at(F.array(*[F.lit(name) for name in MONTHS]), F.month(stamp))


def day_name(stamp: str) -> Column:
    return F.element_at(F.array(*[F.lit(name) for name in WEEKDAYS]), F.dayofweek(stamp))


def hours_crossed(start: str, end: str) -> Column:
    """Hour boundaries between two instants, not elapsed hours."""
    return F.timestamp_diff("HOUR", F.date_trunc("HOUR", start), F.date_trunc("HOUR", end))


PAYMENT_COLUMNS = ("payment_type", "payment_installments", "total_payment_value")


def sales_fact(
    order_items: DataFrame, orders: DataFrame, customers: DataFrame, order_payments: DataFrame | None
) -> DataFrame:
    """One row per order item, 37 columns.

    ``total_payment_value`` belongs to the order and repeats on each of its items.
    Questions that ignore payments pass none and save that aggregation and join.
    """
    bought, delivered, due = "order_purchase_timestamp", "order_delivered_customer_date", "order_estimated_delivery_date"
    arrived = F.col(delivered)
    # Everything known per order is joined to the orders first: the items, by far
    # the larger side, then move once, in a join that may split a hot order.
    people = customers.select("customer_id", "customer_unique_id", "customer_zip_code_prefix")
    headers = orders.join(people, "customer_id", "left")
    columns = sales_columns(bought, delivered, due, arrived)
    if order_payments is not None:
        headers = headers.join(payments_per_order(order_payments), "order_id", "left")
        columns += list(PAYMENT_COLUMNS)
    return order_items.join(headers, "order_id").select(*columns)


def sales_columns(bought: str, delivered: str, due: str, arrived: Column) -> list:
    """Ids, date keys, dates, time attributes, measures and flags of a sold item."""
    return [
        "order_id",
        "order_item_id",
        "product_id",
        "seller_id",
        F.col("customer_unique_id").alias("customer_id"),
        F.col("customer_zip_code_prefix").alias("customer_zip_code"),
        date_key(bought).alias("order_date_key"),
        date_key("order_approved_at").alias("approved_date_key"),
        date_key("shipping_limit_date").alias("shipping_limit_date_key"),
        date_key("order_delivered_carrier_date").alias("carrier_delivery_date_key"),
        date_key(delivered).alias("customer_delivery_date_key"),
        date_key(due).alias("estimated_delivery_date_key"),
        F.to_date(bought).alias("order_date"),
        F.to_date("order_approved_at").alias("approved_date"),
        F.to_date("order_delivered_carrier_date").alias("carrier_delivery_date"),
        F.to_date(delivered).alias("customer_delivery_date"),
        F.to_date(due).alias("estimated_delivery_date"),
        F.year(bought).alias("order_year"),
        F.quarter(bought).alias("order_quarter"),
        F.month(bought).alias("order_month"),
        month_name(bought).alias("order_month_name"),
        F.substring(F.to_date(bought).cast("string"), 1, 7).alias("order_year_month"),
        day_name(bought).alias("order_day_name"),
        F.when(F.dayofweek(bought).isin(1, 7), 1).otherwise(0).alias("is_weekend_order"),
        "price",
        "freight_value",
        (F.col("price") + F.col("freight_value")).alias("line_total"),
        F.datediff(F.to_date(delivered), F.to_date(bought)).alias("delivery_days"),
        F.datediff(F.to_date(delivered), F.to_date(due)).alias("delivery_variance_days"),
        hours_crossed(bought, "order_approved_at").alias("approval_hours"),
        F.when(F.col("order_status") == "delivered", 1).otherwise(0).alias("is_delivered"),
        F.when(arrived > F.col(due), 1).when(arrived.isNotNull(), 0).alias("is_late"),
        F.when(arrived <= F.col(due), "On Time").when(arrived.isNull(), "Pending").otherwise("Late").alias("delivery_status"),
        "order_status",
    ]


def row_counts(views: dict[str, DataFrame]) -> DataFrame:
    """Name and number of rows of each view."""
    counted = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("view"), "rows") for name, df in views.items()]
    result = counted[0]
    for part in counted[1:]:
        result = result.unionByName(part)
    return result

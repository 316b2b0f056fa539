"""E-commerce tables (orders, items, payments, people, products) over the order tables.

Prices, freight and payments are integers in 1/10000 of the currency.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.numeric import hundredths, money
from tallybook.sources.retail import Retail
from tallybook.sources.tables import Tables

# Product line -> shown category; one line has no translation.
TRANSLATION = {
    "ECONOMY": "economy_furniture",
    "MEDIUM": "health_beauty",
    "PROMO": "promo_gifts",
    "LARGE": "large_furniture",
    "SMALL": "small_appliances",
}
PAYMENT_TYPES = ("boleto", "credit_card", "voucher")
PAID_PERCENT = 50


def later(stamp: str, days: Column, hours: Column) -> Column:
    return F.col(stamp) + F.make_dt_interval(days, hours)


class Ecommerce:
    """Source tables of the star views, one method per table."""

    def __init__(self, tables: Tables):
        self.t = tables

    def dim_date(self) -> DataFrame:
        days = Retail(self.t).calendar()
        return days.select(
            F.date_format("d_date", "yyyyMMdd").cast("int").alias("date_key"),
            F.col("d_date").alias("date"),
            F.col("d_year").alias("year"),
            F.col("d_qoy").alias("quarter"),
            F.col("d_moy").alias("month_number"),
            F.date_format("d_date", "MMMM").alias("month_name"),
            F.date_format("d_date", "yyyy-MM").alias("year_month"),
            F.col("d_dom").alias("day_of_month"),
            (F.col("d_dow") + 1).alias("day_of_week"),
            F.col("d_day_name").alias("day_name"),
            F.dayofyear("d_date").alias("day_of_year"),
            F.when(F.col("d_dow").isin(0, 6), 1).otherwise(0).alias("is_weekend"),
        )

    def customers(self) -> DataFrame:
        return self._people().drop("balance")

    def _people(self) -> DataFrame:
        """Two customer ids share one natural person."""
        key = F.col("c_custkey")
        return (
            self.t["customer"]
            .join(F.broadcast(self.t["nation"]), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(F.broadcast(self.t["region"]), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                key.alias("customer_id"),
                F.floor(key / 2).cast("long").alias("customer_unique_id"),
                zip_code(key).alias("customer_zip_code_prefix"),
                F.lower("n_name").alias("customer_city"),
                F.lower("r_name").alias("customer_state"),
                money("c_acctbal").alias("balance"),
            )
        )

    def geolocation(self) -> DataFrame:
        return self._people().select(
            F.col("customer_zip_code_prefix").alias("geolocation_zip_code_prefix"),
            F.col("customer_city").alias("geolocation_city"),
            F.col("customer_state").alias("geolocation_state"),
            (F.col("balance") / 1000).cast("decimal(12,5)").alias("geolocation_lat"),
            (F.col("balance") / -500).cast("decimal(12,5)").alias("geolocation_lng"),
        )

    def products(self) -> DataFrame:
        size = F.col("p_size")
        return self.t["part"].select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_type").alias("product_category_name"),
            F.length("p_name").alias("product_name_lenght"),
            F.length(F.concat("p_name", "p_brand")).alias("product_description_lenght"),
            (size % 5).alias("product_photos_qty"),
            (size * 10).alias("product_weight_g"),
            (size + 5).alias("product_length_cm"),
            (size + 2).alias("product_height_cm"),
            (size + 1).alias("product_width_cm"),
        )

    def translation(self) -> DataFrame:
        pairs = F.create_map(*[F.lit(word) for pair in TRANSLATION.items() for word in pair])
        names = ("product_category_name", "product_category_name_english")
        return self.t.spark.range(1).select(F.explode(pairs).alias(*names))

    def sellers(self) -> DataFrame:
        return (
            self.t["supplier"]
            .join(F.broadcast(self.t["nation"]), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(F.broadcast(self.t["region"]), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("s_suppkey").alias("seller_id"),
                zip_code(F.col("s_suppkey")).alias("seller_zip_code_prefix"),
                F.lower("n_name").alias("seller_city"),
                F.lower("r_name").alias("seller_state"),
            )
        )

    def order_payments(self) -> DataFrame:
        """One or two payments per order."""
        key, turn = F.col("o_orderkey"), F.col("turn")
        kinds = F.array(*[F.lit(kind) for kind in PAYMENT_TYPES])
        paid = self.t["orders"].withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), 1 + key % 2)))
        return paid.select(
            key.alias("order_id"),
            (hundredths("o_totalprice") * PAID_PERCENT).alias("payment_value"),
            (1 + (key + turn) % 10).cast("int").alias("payment_installments"),
            F.get(kinds, ((key + turn) % 3).cast("int")).alias("payment_type"),
        )

    def order_items(self) -> DataFrame:
        return self.t["lineitem"].select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("order_item_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
            (hundredths("l_extendedprice") * 100).alias("price"),
            (hundredths("l_extendedprice") * hundredths("l_tax")).alias("freight_value"),
            F.col("l_shipdate").alias("shipping_limit_date"),
        )

    def orders(self) -> DataFrame:
        """Orders with the status and delivery times of a shipping process."""
        key = F.col("o_orderkey")
        status = F.when(F.col("o_orderstatus") == "F", "delivered").when(F.col("o_orderstatus") == "O", "approved")
        delivered = F.when(F.col("o_orderstatus") == "F", later("o_orderdate", (key * 7 % 41).cast("int"), (key % 24).cast("int")))
        return self.t["orders"].select(
            key.alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            status.otherwise("processing").alias("order_status"),
            F.col("o_orderdate").alias("order_purchase_timestamp"),
            (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), (key % 50).cast("int"), (key % 60).cast("int"))).alias("order_approved_at"),
            later("o_orderdate", (key % 6).cast("int"), F.lit(0)).alias("order_delivered_carrier_date"),
            delivered.alias("order_delivered_customer_date"),
            later("o_orderdate", F.lit(21), F.lit(0)).alias("order_estimated_delivery_date"),
        )


def zip_code(key: Column) -> Column:
    """Zip of a person: 400 prefixes."""
    return F.lpad((key % 400).cast("string"), 5, "0")

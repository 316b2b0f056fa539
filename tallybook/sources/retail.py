"""Retail-shaped views (facts, dimensions, calendar) over the order tables.

Facts take an optional date range that is applied to the raw timestamp column,
so that it reaches the Parquet scan; the calendar join stays for its attributes.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.numeric import hundredths
from tallybook.sources.tables import Tables

DAY_ZERO = "1900-01-01"
STORE, CATALOG, WEB = 0, 1, 2
COST_PERCENT = 60


def day_number(day: Column) -> Column:
    return F.datediff(day, F.lit(DAY_ZERO).cast("date"))


def day_range(stamp: str, since: str | None, until: str | None) -> Column:
    """Whole days ``since``..``until`` (both included) on a raw timestamp column."""
    test = F.lit(True)
    if since:
        test = test & (F.col(stamp) >= F.lit(since).cast("timestamp_ntz"))
    if until:
        test = test & (F.col(stamp) < F.date_add(F.lit(until).cast("date"), 1).cast("timestamp_ntz"))
    return test


class Retail:
    """Retail views of one data directory."""

    def __init__(self, tables: Tables):
        self.t = tables

    def calendar(self) -> DataFrame:
        """One row per day, from the first year of the orders to the year after their last."""
        years = self.t["orders"].agg(F.year(F.min("o_orderdate")).alias("first"), F.year(F.max("o_orderdate")).alias("last"))
        span = F.sequence(F.make_date("first", F.lit(1), F.lit(1)), F.make_date(F.col("last") + 1, F.lit(12), F.lit(31)))
        days = years.select(F.explode(span).alias("d_date"))
        sk = day_number(F.col("d_date"))
        return days.select(
            "d_date",
            sk.alias("d_date_sk"),
            F.floor(sk / 7).cast("int").alias("d_week_seq"),
            ((F.year("d_date") - 1900) * 12 + F.month("d_date") - 1).alias("d_month_seq"),
            (F.dayofweek("d_date") - 1).alias("d_dow"),
            F.date_format("d_date", "EEEE").alias("d_day_name"),
            F.dayofmonth("d_date").alias("d_dom"),
            F.month("d_date").alias("d_moy"),
            F.quarter("d_date").alias("d_qoy"),
            F.year("d_date").alias("d_year"),
        )

    def lines(self) -> DataFrame:
        """Order lines with amounts as integers in 1/10000; no join."""
        price = hundredths("l_extendedprice")
        cut = price * hundredths("l_discount")
        return self.t["lineitem"].select(
            F.col("l_orderkey").alias("ss_ticket_number"),
            F.col("l_partkey").alias("ss_item_sk"),
            F.col("l_suppkey").alias("ss_store_sk"),
            (F.col("l_linenumber") % 3).alias("channel"),
            F.col("l_quantity").cast("int").alias("ss_quantity"),
            (price * 100).alias("ss_ext_list_price"),
            cut.alias("ss_coupon_amt"),
            (price * 100 - cut).alias("ss_ext_sales_price"),
            (price * hundredths("l_tax")).alias("net_loss"),
            (F.col("l_returnflag") == "R").alias("is_return"),
            F.col("l_shipdate"),
        )

    def with_cost(self, lines: DataFrame) -> DataFrame:
        """Add wholesale cost and profit, which need the item price."""
        part = self.t["part"].select(
            F.col("p_partkey").alias("ss_item_sk"), hundredths("p_retailprice").alias("retail")
        )
        cost = F.col("retail") * F.col("ss_quantity") * COST_PERCENT
        return (
            lines.join(part, "ss_item_sk")
            .withColumn("ss_ext_wholesale_cost", cost)
            .withColumn("ss_net_profit", F.col("ss_ext_sales_price") - F.col("ss_ext_wholesale_cost"))
            .drop("retail")
        )

    def orders(self, since: str | None = None, until: str | None = None) -> DataFrame:
        return self.orders_of((since, until))

    def orders_of(self, *spans: tuple[str | None, str | None]) -> DataFrame:
        """Orders of several spans of days (both ends included, None open)."""
        return (
            self.t["orders"]
            .filter(reduce(or_, [day_range("o_orderdate", *span) for span in spans]))
            .select(
                F.col("o_orderkey").alias("ss_ticket_number"),
                F.col("o_custkey").alias("ss_customer_sk"),
                day_number(F.col("o_orderdate").cast("date")).alias("ss_sold_date_sk"),
            )
        )

    def sales(self, since: str | None = None, until: str | None = None) -> DataFrame:
        """Lines with customer and sale day."""
        return self.sales_of((since, until))

    def sales_of(self, *spans: tuple[str | None, str | None]) -> DataFrame:
        """The same of several spans of days, in one reading."""
        return self.lines().join(self.orders_of(*spans), "ss_ticket_number")

    def returns(self, since: str | None = None, until: str | None = None) -> DataFrame:
        """Returned lines; the return day is the ship day."""
        return (
            self.lines()
            .filter(F.col("is_return") & day_range("l_shipdate", since, until))
            .withColumn("sr_returned_date_sk", day_number(F.col("l_shipdate").cast("date")))
        )

    def item(self) -> DataFrame:
        return self.t["part"].select(
            F.col("p_partkey").alias("i_item_sk"),
            F.format_string("Item#%09d", "p_partkey").alias("i_item_id"),
            F.col("p_name").alias("i_product_name"),
            F.col("p_brand").alias("i_brand"),
            F.substring_index("p_brand", "#", -1).cast("int").alias("i_brand_id"),
            F.col("p_type").alias("i_category"),
            F.col("p_size").alias("i_class"),
            F.col("p_size").alias("i_manufact_id"),
            F.concat(F.lit("Manufact#"), F.col("p_size").cast("string")).alias("i_manufact"),
            (F.col("p_partkey") % 10).alias("i_manager_id"),
        )

    def store(self) -> DataFrame:
        nation = self.t["nation"].join(
            F.broadcast(self.t["region"]), F.col("n_regionkey") == F.col("r_regionkey")
        )
        return (
            self.t["supplier"]
            .join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("s_suppkey").alias("s_store_sk"),
                F.col("s_name").alias("s_store_id"),
                F.col("n_name").alias("s_state"),
                F.col("n_name").alias("s_city"),
                F.col("r_name").alias("s_county"),
                F.lpad(F.col("s_nationkey").cast("string"), 5, "0").alias("s_zip"),
            )
        )

    def at_store(self, lines: DataFrame, *columns: str, where: Column | None = None) -> DataFrame:
        """Lines with their key and ``columns`` of ``store()``, of the stores that satisfy ``where``.

        The same rows as a join with ``store()``. Suppliers and nations are joined one after the
        other: of the two joined Spark takes the product of their sizes, and would shuffle all
        lines by store although the suppliers are few.
        """
        supplier = self.t["supplier"].select(F.col("s_suppkey").alias("s_store_sk"), F.col("s_name").alias("s_store_id"), "s_nationkey")
        nation = self.t["nation"].join(F.broadcast(self.t["region"]), F.col("n_regionkey") == F.col("r_regionkey"))
        places = nation.select(
            "n_nationkey",
            F.col("n_name").alias("s_state"),
            F.col("n_name").alias("s_city"),
            F.col("r_name").alias("s_county"),
            F.lpad(F.col("n_nationkey").cast("string"), 5, "0").alias("s_zip"),
        )
        found = lines.join(supplier, F.col("ss_store_sk") == F.col("s_store_sk")).join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey"))
        return (found if where is None else found.filter(where)).select(*lines.columns, "s_store_sk", *columns)

    def customer(self) -> DataFrame:
        """Customers with their household and demographic attributes."""
        key = F.col("c_custkey")
        return self.t["customer"].select(
            key.alias("c_customer_sk"),
            F.col("c_name").alias("c_customer_id"),
            F.substring_index("c_name", "#", 1).alias("c_first_name"),
            F.substring_index("c_name", "#", -1).alias("c_last_name"),
            F.when(F.col("c_acctbal") < 0, "Dr.").otherwise("Mx.").alias("c_salutation"),
            F.when(F.col("c_acctbal") > 5000, "Y").otherwise("N").alias("c_preferred_cust_flag"),
            key.alias("c_current_addr_sk"),
            F.when(key % 2 == 0, "M").otherwise("F").alias("cd_gender"),
            F.col("c_mktsegment").alias("cd_education_status"),
            F.col("c_mktsegment").alias("hd_buy_potential"),
            (key % 10).alias("hd_dep_count"),
            (key % 5).alias("hd_vehicle_count"),
        )

    def address(self) -> DataFrame:
        return (
            self.t["customer"]
            .join(F.broadcast(self.t["nation"]), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("c_custkey").alias("ca_address_sk"),
                F.col("n_name").alias("ca_city"),
                F.col("n_name").alias("ca_state"),
                F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("ca_zip"),
            )
        )

    def ship_address(self) -> Column:
        """Address of a sale: a customer row other than the buyer's own."""
        people = self.t["customer"].select(F.count(F.lit(1))).scalar()
        return (F.col("ss_customer_sk") + F.col("ss_store_sk")) % people

    def web_site(self) -> DataFrame:
        """Sites are nations, their companies regions."""
        return (
            self.t["nation"]
            .join(F.broadcast(self.t["region"]), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("n_nationkey").alias("web_site_sk"),
                F.col("n_name").alias("web_site_id"),
                F.col("r_name").alias("web_company_name"),
            )
        )

"""Decision-support suite over the retail views."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallybook.functions.numeric import amount_if, count_if, exact_sum, mean, mean_amount, ratio, sum_if
from tallybook.sources.retail import CATALOG, STORE, WEB, Retail
from tallybook.sources.tables import Tables

TOP = 100
WEEKDAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")


def retail(spark: SparkSession, sf_dir: str) -> Retail:
    return Retail(Tables(spark, sf_dir))


def nulls_first(*names: str):
    return [F.col(name).asc_nulls_first() for name in names]


def tpc_q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose returns at a store exceed 1.2 x that store's average."""
    r = retail(spark, sf_dir)
    buyer = r.orders().select("ss_ticket_number", "ss_customer_sk")
    returned = (
        r.at_store(r.returns("2000-01-01", "2000-12-31"), where=F.col("s_state") == "NATION_3")
        .join(buyer, "ss_ticket_number")
        .groupBy("ss_customer_sk", "ss_store_sk")
        .agg(exact_sum("ss_ext_sales_price").alias("returned"))
    )
    usual = returned.groupBy("ss_store_sk").agg(mean("returned").alias("usual"))
    return (
        returned.join(usual, "ss_store_sk")
        .filter(F.col("returned").cast("double") > F.col("usual") * 1.2)
        .join(r.customer(), F.col("ss_customer_sk") == F.col("c_customer_sk"))
        .select("c_customer_id")
        .orderBy("c_customer_id")
        .limit(TOP)
    )


def tpc_q2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekday sales of a year over those 53 weeks later, web and catalog together."""
    r = retail(spark, sf_dir)
    days = F.broadcast(r.calendar())
    by_day = (
        r.sales("1999-12-01", "2002-01-31")
        .filter(F.col("channel").isin(WEB, CATALOG))
        .groupBy("ss_sold_date_sk")
        .agg(exact_sum("ss_ext_sales_price").alias("sales"))
    )
    weekly = (
        by_day.join(days, F.col("ss_sold_date_sk") == F.col("d_date_sk"))
        .groupBy("d_week_seq")
        .agg(*[F.coalesce(sum_if(F.col("d_day_name") == day, "sales"), F.lit(0)).alias(day) for day in WEEKDAYS])
    )

    def weeks_of(year: int, suffix: str) -> DataFrame:
        # One row per calendar day of the week, as the day-grain join asks for.
        in_year = days.filter(F.col("d_year") == year).select("d_week_seq")
        named = [F.col(day).alias(f"{day}{suffix}") for day in WEEKDAYS]
        return weekly.join(in_year, "d_week_seq").select(F.col("d_week_seq").alias(f"week{suffix}"), *named)

    first, second = weeks_of(2000, "1"), weeks_of(2001, "2")
    return (
        first.join(second, F.col("week1") == F.col("week2") - 53)
        .select(
            F.col("week1").alias("d_week_seq1"),
            *[ratio(F.col(f"{d}1"), F.col(f"{d}2")).alias(f"{d[:3].lower()}_ratio") for d in WEEKDAYS],
        )
        .orderBy("d_week_seq1")
    )


def tpc_q3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand revenue by year of one manufacturer in November."""
    r = retail(spark, sf_dir)
    items = r.item().filter(F.col("i_manufact_id") == 10).select("i_item_sk", "i_brand", "i_brand_id")
    november = r.calendar().filter(F.col("d_moy") == 11).select("d_date_sk", "d_year")
    return (
        r.lines()
        .join(items, F.col("ss_item_sk") == F.col("i_item_sk"))
        .join(
            r.orders().join(F.broadcast(november), F.col("ss_sold_date_sk") == F.col("d_date_sk")),
            "ss_ticket_number",
        )
        .groupBy("d_year", F.col("i_brand").alias("brand"), F.col("i_brand_id").alias("brand_id"))
        .agg(exact_sum("ss_ext_sales_price").alias("exact"))
        .orderBy("d_year", F.desc("exact"), "brand_id")
        .limit(TOP)
        .select("d_year", "brand_id", "brand", total_column("exact", "sum_agg"))
    )


def total_column(name: str, alias: str):
    return F.col(name).cast("double").alias(alias)


def tpc_q4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose growth in one reading of the year totals beats two others.

    All six readings are the same totals, so a customer appears once for every
    (c, s, w) choice of growth ratios with c > s and c > w: the number of
    ratios below c, squared. That count replaces the six-way self-join.
    """
    r = retail(spark, sf_dir)
    # One amount of each line is shuffled, not three.
    gross = F.col("ss_ext_list_price") - F.col("ss_coupon_amt") + F.col("ss_ext_sales_price")
    sales = r.lines().withColumn("gross", gross).join(r.orders("1999-01-01", "2000-12-31"), "ss_ticket_number")
    worth = F.col("gross") - F.col("ss_ext_wholesale_cost")
    day = F.broadcast(r.calendar().select("d_date_sk", "d_year"))
    totals = (
        r.at_store(r.with_cost(sales), "s_county")
        .join(day, F.col("ss_sold_date_sk") == F.col("d_date_sk"))
        .groupBy("ss_customer_sk", "s_county")
        .agg(
            # Halving cancels in every ratio and keeps the sign.
            amount_if(F.col("d_year") == 1999, worth).cast("double").alias("before"),
            amount_if(F.col("d_year") == 2000, worth).cast("double").alias("after"),
        )
    )
    before = totals.filter(F.col("before") > 0).select("ss_customer_sk", "before")
    after = totals.filter(F.col("after").isNotNull()).select("ss_customer_sk", "after")
    growth = before.join(after, "ss_customer_sk").select("ss_customer_sk", ratio(F.col("after"), F.col("before")).alias("growth"))
    ascending = W.partitionBy("ss_customer_sk").orderBy("growth")
    repeats = (
        growth.withColumn("below", F.rank().over(ascending) - 1)
        .groupBy("ss_customer_sk")
        .agg(F.sum(F.col("below").cast("long") * F.col("below")).alias("copies"))
        .filter(F.col("copies") > 0)
    )
    named = (
        repeats.join(r.customer(), F.col("ss_customer_sk") == F.col("c_customer_sk"))
        .select("c_customer_id", "c_first_name", "c_last_name", "copies")
        .orderBy("c_customer_id", "c_first_name", "c_last_name")
        .limit(TOP)
    )
    # Only TOP rows are reported, so no customer needs more copies than that.
    copies = F.sequence(F.lit(1), F.least(F.col("copies"), F.lit(TOP)).cast("int"))
    return (
        named.withColumn("copy", F.explode(copies))
        .orderBy("c_customer_id", "c_first_name", "c_last_name")
        .limit(TOP)
        .select(
            F.col("c_customer_id").alias("customer_id"),
            F.col("c_first_name").alias("customer_first_name"),
            F.col("c_last_name").alias("customer_last_name"),
        )
    )


def tpc_q5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales, returns and profit by channel and outlet, with subtotals."""
    r = retail(spark, sf_dir)
    since, until = "2000-08-23", "2000-09-06"
    outlet = F.when(F.col("channel") == CATALOG, F.col("ss_item_sk")).when(
        F.col("channel") == WEB, F.col("ss_store_sk") % 25
    ).otherwise(F.col("ss_store_sk"))
    none = exact_sum(F.lit(0).cast("long"))
    sold = (
        r.with_cost(r.sales(since, until))
        .groupBy("channel", outlet.alias("outlet"))
        .agg(
            exact_sum("ss_ext_sales_price").alias("sales"),
            exact_sum("ss_net_profit").alias("profit"),
            none.alias("returned"),
            none.alias("loss"),
        )
    )
    returned = r.returns(since, until)
    direct = (
        returned.filter(F.col("channel") != WEB)
        .groupBy("channel", outlet.alias("outlet"))
        .agg(
            none.alias("sales"),
            none.alias("profit"),
            exact_sum("ss_ext_sales_price").alias("returned"),
            exact_sum("net_loss").alias("loss"),
        )
    )
    everything = sold.unionByName(direct).unionByName(web_returns(r, returned))
    stores = r.store().select(F.lit(STORE).alias("channel"), F.col("s_store_sk").alias("outlet"), F.col("s_store_id").alias("name"))
    pages = r.item().select(F.lit(CATALOG).alias("channel"), F.col("i_item_sk").alias("outlet"), F.col("i_brand").alias("name"))
    sites = r.web_site().select(F.lit(WEB).alias("channel"), F.col("web_site_sk").cast("long").alias("outlet"), F.col("web_site_id").alias("name"))
    names = stores.unionByName(pages).unionByName(sites)
    label = F.element_at(F.array(F.lit("store channel"), F.lit("catalog channel"), F.lit("web channel")), F.col("channel") + 1)
    prefix = F.element_at(F.array(F.lit("store"), F.lit("catalog_page"), F.lit("web_site")), F.col("channel") + 1)
    return (
        everything.join(names, ["channel", "outlet"])
        .select(
            label.alias("channel"),
            F.concat(prefix, "name").alias("id"),
            "sales",
            "returned",
            (F.col("profit") - F.col("loss")).alias("net"),
        )
        .rollup("channel", "id")
        .agg(
            F.sum("sales").cast("double").alias("total_sales"),
            F.sum("returned").cast("double").alias("total_returns"),
            F.sum("net").cast("double").alias("total_profit"),
        )
        .orderBy(*nulls_first("channel", "id"))
        .limit(TOP)
    )


def web_returns(r: Retail, returned: DataFrame) -> DataFrame:
    """Web returns by the site of the matching web sales (item and order equal).

    Both sides are summed per key first; a return then counts once per matching
    sale, as in the row-wise outer join, without materialising the pairs.
    """
    keys = ["ss_item_sk", "ss_ticket_number"]
    back = (
        returned.filter(F.col("channel") == WEB)
        .groupBy(*keys)
        .agg(exact_sum("ss_ext_sales_price").alias("returned"), exact_sum("net_loss").alias("loss"))
    )
    sold = (
        r.lines()
        .filter(F.col("channel") == WEB)
        .join(back.select(*keys), keys, "left_semi")
        .groupBy(*keys, (F.col("ss_store_sk") % 25).alias("outlet"))
        .agg(F.count(F.lit(1)).alias("sales_rows"))
    )
    times = F.coalesce("sales_rows", F.lit(1)).cast("decimal(10,0)")
    none = exact_sum(F.lit(0).cast("long"))
    return (
        back.join(sold, keys, "left")
        .groupBy(F.lit(WEB).alias("channel"), "outlet")
        .agg(
            none.alias("sales"),
            none.alias("profit"),
            F.sum(F.col("returned").cast("decimal(24,4)") * times).alias("returned"),
            F.sum(F.col("loss").cast("decimal(24,4)") * times).alias("loss"),
        )
    )


def tpc_q19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand revenue where buyer and store have different zip prefixes."""
    r = retail(spark, sf_dir)
    items = r.item().filter(F.col("i_manager_id") == 8)
    home = r.address().select("ca_address_sk", "ca_zip")
    buyer = r.customer().join(home, F.col("c_current_addr_sk") == F.col("ca_address_sk")).select("c_customer_sk", "ca_zip")
    orders = r.orders("1998-11-01", "1998-11-30").join(buyer, F.col("ss_customer_sk") == F.col("c_customer_sk"))
    return (
        r.at_store(r.lines().join(items, F.col("ss_item_sk") == F.col("i_item_sk")), "s_zip")
        .join(orders, "ss_ticket_number")
        .filter(F.substring("ca_zip", 1, 5) != F.substring("s_zip", 1, 5))
        .groupBy("i_brand", "i_brand_id", "i_manufact_id", "i_manufact")
        .agg(exact_sum("ss_ext_sales_price").alias("exact"))
        .orderBy(F.desc("exact"), "i_brand", "i_brand_id", "i_manufact_id", "i_manufact")
        .limit(TOP)
        .select(
            F.col("i_brand_id").alias("brand_id"),
            F.col("i_brand").alias("brand"),
            "i_manufact_id",
            "i_manufact",
            total_column("exact", "ext_price"),
        )
    )


def tpc_q27(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item averages by state with subtotals and the grouping flag."""
    r = retail(spark, sf_dir)
    states = F.col("s_state").isin("NATION_3", "NATION_7", "NATION_11")
    people = r.customer().filter((F.col("cd_gender") == "M") & (F.col("cd_education_status") == "BUILDING")).select("c_customer_sk")
    orders = r.orders("2000-01-01", "2000-12-31").join(
        people, F.col("ss_customer_sk") == F.col("c_customer_sk"), "left_semi"
    )
    return (
        r.at_store(r.lines(), "s_state", where=states)
        .join(orders, "ss_ticket_number")
        .join(r.item().select("i_item_sk", "i_item_id"), F.col("ss_item_sk") == F.col("i_item_sk"))
        .rollup("i_item_id", "s_state")
        .agg(
            F.grouping("s_state").cast("int").alias("g_state"),
            mean("ss_quantity").alias("agg1"),
            mean_amount("ss_ext_list_price").alias("agg2"),
            mean_amount("ss_coupon_amt").alias("agg3"),
            mean_amount("ss_ext_sales_price").alias("agg4"),
        )
        .orderBy(*nulls_first("i_item_id", "s_state"))
        .limit(TOP)
    )


def tpc_q34(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with tickets of a given number of lines on month edges."""
    r = retail(spark, sf_dir)
    edges = r.calendar().filter(F.col("d_dom").between(1, 3) | F.col("d_dom").between(25, 28)).select("d_date_sk")
    counties = F.col("s_county").isin("ASIA", "EUROPE", "AMERICA")
    cars = F.col("hd_vehicle_count")
    people = r.customer().filter(
        F.col("hd_buy_potential").isin("BUILDING", "MACHINERY")
        & (cars > 0)
        & (F.when(cars > 0, ratio(F.col("hd_dep_count"), cars)) > 1.2)
    )
    orders = (
        r.orders("1999-01-01", "2001-12-31")
        .join(F.broadcast(edges), F.col("ss_sold_date_sk") == F.col("d_date_sk"))
        .join(people, F.col("ss_customer_sk") == F.col("c_customer_sk"), "left_semi")
    )
    tickets = (
        r.at_store(r.lines(), where=counties)
        .join(orders, "ss_ticket_number")
        .groupBy("ss_ticket_number", "ss_customer_sk")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .filter(F.col("cnt").between(3, 4))
    )
    return (
        tickets.join(people, F.col("ss_customer_sk") == F.col("c_customer_sk"))
        .select("c_last_name", "c_first_name", "c_salutation", "c_preferred_cust_flag", "ss_ticket_number", "cnt")
        .orderBy("c_last_name", "c_first_name", "c_salutation", F.desc("c_preferred_cust_flag"), "ss_ticket_number")
    )


def tpc_q46(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekend tickets bought in a city other than the buyer's own."""
    r = retail(spark, sf_dir)
    weekend = r.calendar().filter(F.col("d_dow").isin(6, 0)).select("d_date_sk")
    cities = F.col("s_city").isin("NATION_3", "NATION_7")
    people = r.customer().filter((F.col("hd_dep_count") == 4) | (F.col("hd_vehicle_count") == 3))
    orders = (
        r.orders("1999-01-01", "2001-12-31")
        .join(F.broadcast(weekend), F.col("ss_sold_date_sk") == F.col("d_date_sk"))
        .join(people, F.col("ss_customer_sk") == F.col("c_customer_sk"), "left_semi")
    )
    bought_at = r.address().select(F.col("ca_address_sk").alias("ss_addr_sk"), F.col("ca_city").alias("bought_city"))
    home = r.address().select("ca_address_sk", "ca_city")
    tickets = (
        r.with_cost(r.at_store(r.lines(), where=cities).join(orders, "ss_ticket_number"))
        .withColumn("ss_addr_sk", r.ship_address())
        .groupBy("ss_ticket_number", "ss_customer_sk", "ss_addr_sk")
        .agg(exact_sum("ss_coupon_amt").alias("coupons"), exact_sum("ss_net_profit").alias("gain"))
        .join(bought_at, "ss_addr_sk")
    )
    return (
        tickets.join(people, F.col("ss_customer_sk") == F.col("c_customer_sk"))
        .join(home, F.col("c_current_addr_sk") == F.col("ca_address_sk"))
        .filter(F.col("ca_city") != F.col("bought_city"))
        .orderBy("c_last_name", "c_first_name", "ca_city", "bought_city", "ss_ticket_number", "coupons", "gain")
        .limit(TOP)
        .select(
            "c_last_name", "c_first_name", "ca_city", "bought_city", "ss_ticket_number",
            total_column("coupons", "amt"), total_column("gain", "profit"),
        )
    )


def tpc_q67(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best 100 per category over an eight-level rollup."""
    r = retail(spark, sf_dir)
    levels = ["i_category", "i_class", "i_brand", "i_product_name", "d_year", "d_qoy", "d_moy", "s_store_id"]
    # Summed to the finest level first: the rollup then expands groups, not sales.
    finest = (
        r.at_store(r.sales("2000-01-01", "2000-12-31"), "s_store_id")
        .join(F.broadcast(r.calendar()), F.col("ss_sold_date_sk") == F.col("d_date_sk"))
        .join(r.item(), F.col("ss_item_sk") == F.col("i_item_sk"))
        .groupBy(*levels)
        .agg(exact_sum(F.coalesce(F.col("ss_ext_sales_price") * F.col("ss_quantity"), F.lit(0))).alias("part_sum"))
    )
    ranked = (
        finest.rollup(*levels)
        .agg(F.sum("part_sum").alias("exact"))
        .withColumn("rk", F.rank().over(W.partitionBy("i_category").orderBy(F.desc("exact"))))
        .filter(F.col("rk") <= 100)
    )
    return (
        ranked.orderBy(*nulls_first(*levels), "exact", "rk")
        .limit(TOP)
        .select(*levels, total_column("exact", "sumsales"), "rk")
    )


def tpc_q72(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose stock rose three Januaries in a row.

    Stock has one row per item, warehouse and January, so the three readings are
    columns of one aggregation rather than a three-way self-join.
    """
    r = retail(spark, sf_dir)
    years = (1999, 2000, 2001)
    first_quarter = r.calendar().filter((F.col("d_qoy") == 1) & F.col("d_year").isin(*years)).select("d_date_sk", "d_year")
    quarters = r.sales_of(*[(f"{y}-01-01", f"{y}-03-31") for y in years])
    stock = (
        quarters
        .join(F.broadcast(first_quarter), F.col("ss_sold_date_sk") == F.col("d_date_sk"))
        .groupBy("ss_item_sk", (F.col("ss_store_sk") % 2).alias("warehouse_sk"))
        .agg(*[sum_if(F.col("d_year") == y, "ss_quantity").alias(f"inv_quantity_on_hand_{n}") for n, y in enumerate(years, 1)])
        .filter("inv_quantity_on_hand_1 < inv_quantity_on_hand_2 AND inv_quantity_on_hand_2 < inv_quantity_on_hand_3")
    )
    warehouse = r.t["region"].select(F.col("r_regionkey").alias("warehouse_key"), F.col("r_name").alias("w_warehouse_name"))
    when = [
        column
        for n, y in enumerate(years, 1)
        for column in (F.lit(y).alias(f"d{n}_year"), F.lit(1).alias(f"d{n}_moy"), F.lit(1).alias(f"d{n}_dom"))
    ]
    return (
        stock.join(F.broadcast(warehouse), F.col("warehouse_sk") == F.col("warehouse_key"))
        .join(r.item(), F.col("ss_item_sk") == F.col("i_item_sk"))
        .select(
            F.col("i_item_id").alias("i_item_desc"),
            "w_warehouse_name",
            *[f"inv_quantity_on_hand_{n}" for n in (1, 2, 3)],
            *when,
        )
        .orderBy("i_item_desc", "w_warehouse_name")
        .limit(TOP)
    )


def tpc_q95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders shipped from several warehouses and later returned.

    Two per-order aggregations joined on the order: no pairs of warehouses, and the
    lines of the answer's orders only.
    """
    r = retail(spark, sf_dir)
    warehouse = F.col("ss_store_sk") % 5
    company = r.web_site().filter(F.col("web_company_name") == "ASIA").select("web_site_sk")
    state = r.address().filter(F.col("ca_state").isin("NATION_3", "NATION_7")).select("ca_address_sk")
    shipped = r.lines().filter(
        (F.col("l_shipdate") >= F.lit("1999-02-01").cast("timestamp_ntz"))
        & (F.col("l_shipdate") < F.lit("1999-04-03").cast("timestamp_ntz"))
    )
    matching = (
        r.with_cost(shipped)
        .join(F.broadcast(company), F.col("ss_store_sk") % 25 == F.col("web_site_sk"))
        .join(r.orders(), "ss_ticket_number")
        .join(state, r.ship_address() == F.col("ca_address_sk"))
        .groupBy("ss_ticket_number")
        .agg(exact_sum("net_loss").alias("cost"), exact_sum("ss_net_profit").alias("gain"))
    )
    qualified = (
        r.lines()
        .join(matching.select("ss_ticket_number"), "ss_ticket_number", "left_semi")
        .groupBy("ss_ticket_number")
        .agg(F.min(warehouse).alias("low"), F.max(warehouse).alias("high"), count_if(F.col("is_return")).alias("returns"))
        .filter((F.col("low") != F.col("high")) & (F.col("returns") > 0))
        .select("ss_ticket_number")
    )
    return matching.join(qualified, "ss_ticket_number", "left_semi").agg(
        F.count(F.lit(1)).alias("order_count"),
        F.sum("cost").cast("double").alias("total_shipping_cost"),
        F.sum("gain").cast("double").alias("total_net_profit"),
    )


SUITE = {
    "tpc_q1": tpc_q1, "tpc_q2": tpc_q2, "tpc_q3": tpc_q3, "tpc_q4": tpc_q4, "tpc_q5": tpc_q5,
    "tpc_q19": tpc_q19, "tpc_q27": tpc_q27, "tpc_q34": tpc_q34, "tpc_q46": tpc_q46,
    "tpc_q67": tpc_q67, "tpc_q72": tpc_q72, "tpc_q95": tpc_q95,
}

"""DuckDB twins of the dashboard measures and report analyses."""

from tallybook.oracle.retail import SALES, with_views

DASH = """
WITH rows AS (SELECT o_orderdate AS ts, o_orderkey AS order_id, p_type AS category,
  CAST(l_quantity AS INT) * CAST(p_retailprice AS DECIMAL(12,2)) AS revenue
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  WHERE year(o_orderdate) = 2000 AND month(o_orderdate) = 8)
"""

FACTS = with_views(SALES, """
f AS (SELECT sales.*, strftime(o_orderdate, '%Y-%m') AS month, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month_number,
  o_orderdate, o_orderpriority AS ship_mode, c_mktsegment AS segment, r_name AS region, p_type AS category,
  l_returnflag = 'R' AS back
  FROM sales JOIN orders ON l_orderkey = o_orderkey JOIN customer ON sales.o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey)
""")
MARGIN = "CAST(sum(profit) AS DOUBLE) / NULLIF(CAST(sum(ext) AS DOUBLE), 0)"
RATE = "CAST(count(*) FILTER (back) AS DOUBLE) / count(*)"

ORACLES = {
    "dash_kpis": DASH + """
, k AS (SELECT CAST(coalesce(sum(revenue), 0) AS DOUBLE) AS rev, count(*) AS n FROM rows)
SELECT rev AS total_revenue, n AS total_orders, rev / greatest(n, 1) AS average_order_value,
  '$' || format('{:,.2f}', rev) AS total_revenue_text, '$' || format('{:,.2f}', rev / greatest(n, 1)) AS average_order_value_text FROM k""",
    "dash_category_revenue": DASH + "SELECT category, CAST(sum(revenue) AS DOUBLE) AS total_revenue FROM rows GROUP BY 1",
    "dash_sales_trend": DASH + """
SELECT strftime(ts, '%Y-%m-%d') AS timestamp, order_id, category, CAST(revenue AS DOUBLE) AS revenue FROM rows""",
    "bi_return_rate_trend": FACTS + f"""
, m AS (SELECT month, {RATE} AS r FROM f GROUP BY 1 ORDER BY 1 DESC LIMIT 6), h AS (SELECT {RATE} AS hr FROM f)
SELECT month, r AS return_rate, hr AS historical_rate, r - hr AS difference FROM m, h""",
    "bi_revenue_lost_to_returns": FACTS + """
SELECT category, CAST(sum(ext) AS DOUBLE) AS revenue, CAST(sum(CASE WHEN back THEN ext ELSE 0 END) AS DOUBLE) AS lost_revenue,
  100.0::DOUBLE * (CAST(sum(CASE WHEN back THEN ext ELSE 0 END) AS DOUBLE) / CAST(sum(ext) AS DOUBLE)) AS lost_percent
FROM f GROUP BY ROLLUP (category)""",
    "bi_margin_by_ship_mode": FACTS + f"""
SELECT ship_mode, CAST(sum(ext) AS DOUBLE) AS sales, CAST(sum(profit) AS DOUBLE) AS profit, {MARGIN} AS profit_margin FROM f GROUP BY 1""",
    "bi_segment_returns_margin": FACTS + f"""
, first AS (SELECT o_custkey AS c, min(o_orderdate) AS d FROM orders GROUP BY 1)
SELECT CASE WHEN o_orderdate = d THEN 'New' ELSE 'Returning' END AS customer_kind, region, segment,
  count(DISTINCT l_orderkey) AS orders, {RATE} AS return_rate,
  CAST(sum(profit) AS DOUBLE) / count(DISTINCT l_orderkey) AS profit_per_order, {MARGIN} AS profit_margin
FROM f JOIN first ON o_custkey = c GROUP BY 1, 2, 3""",
    "bi_shipping_cost_trend": FACTS + """
, m AS (SELECT month, count(DISTINCT l_orderkey) AS orders, CAST(sum(tax) AS DOUBLE) / count(DISTINCT l_orderkey) AS cost_per_order FROM f GROUP BY 1)
SELECT *, cost_per_order - lag(cost_per_order) OVER (ORDER BY month) AS change FROM m""",
    "bi_purchase_frequency_margin": FACTS + f"""
, m AS (SELECT segment, month, count(DISTINCT o_custkey) AS unique_customers,
  CAST(count(DISTINCT l_orderkey) AS DOUBLE) / count(DISTINCT o_custkey) AS orders_per_customer, {MARGIN} AS profit_margin FROM f GROUP BY 1, 2)
SELECT *, profit_margin - lag(profit_margin) OVER (PARTITION BY segment ORDER BY month) AS margin_shift FROM m""",
    "bi_margin_erosion_products": FACTS + f"""
, p AS (SELECT category, l_partkey AS product, {MARGIN} AS profit_margin FROM f GROUP BY 1, 2),
w AS (SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY profit_margin, product) AS INT) AS place FROM p QUALIFY place <= 3)
SELECT w.category, place, product, profit_margin, month, CAST(sum(qty) AS BIGINT) AS units FROM f JOIN w ON l_partkey = product GROUP BY ALL""",
    "bi_core_region_margin": FACTS + f"""
SELECT CASE WHEN region IN ('AMERICA', 'EUROPE') THEN 'Core' ELSE 'Non-core' END AS region_group,
  CAST(sum(ext) AS DOUBLE) AS sales, CAST(sum(profit) AS DOUBLE) AS profit, {MARGIN} AS profit_margin FROM f GROUP BY 1""",
    "bi_yoy_month_mode": FACTS + """
, c AS (SELECT year, month_number, ship_mode, CAST(sum(tax) AS DOUBLE) AS cost FROM f GROUP BY 1, 2, 3)
SELECT c.*, p.cost AS previous_cost, c.cost / NULLIF(p.cost, 0) AS growth
FROM c LEFT JOIN c p ON c.year = p.year + 1 AND c.month_number = p.month_number AND c.ship_mode = p.ship_mode""",
    "bi_discount_margin_corr": FACTS + """
SELECT segment, count(*) AS lines,
  round(corr(CAST(coupon AS DOUBLE) / CAST(list AS DOUBLE), CAST(profit AS DOUBLE) / CAST(ext AS DOUBLE)), 6) AS correlation FROM f GROUP BY 1""",
    "bi_order_volume_volatility": FACTS + f"""
, o AS (SELECT o_custkey, l_orderkey, {MARGIN} AS m, count(*) FILTER (back) AS b, count(*) AS n FROM f GROUP BY 1, 2),
c AS (SELECT o_custkey, count(*) AS orders, CAST(sum(b) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS rate, stddev_samp(m) AS spread FROM o GROUP BY 1)
SELECT orders, count(*) AS customers, round(avg(rate), 6) AS return_rate, round(avg(spread), 6) AS margin_volatility FROM c GROUP BY 1""",
    "bi_cohort_margin": FACTS + f"""
, c AS (SELECT o_custkey AS ck, min(o_orderdate) AS first_ordered FROM f GROUP BY 1)
SELECT CASE WHEN CAST(first_ordered AS DATE) > (SELECT CAST(max(o_orderdate) AS DATE) - INTERVAL 3 MONTHS FROM orders) THEN 'New' ELSE 'Established' END AS cohort,
  count(DISTINCT ck) AS customers, count(DISTINCT l_orderkey) AS orders, {MARGIN} AS profit_margin FROM f JOIN c ON o_custkey = ck GROUP BY 1""",
}

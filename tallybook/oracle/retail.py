"""DuckDB twins of the decision-support suite."""

CALENDAR = """
cal AS (
  SELECT CAST(g AS DATE) AS d_date,
         date_diff('day', DATE '1900-01-01', CAST(g AS DATE)) AS sk,
         date_diff('day', DATE '1900-01-01', CAST(g AS DATE)) // 7 AS week,
         (year(g) - 1900) * 12 + month(g) - 1 AS month_seq,
         dayofweek(g) AS dow, dayname(g) AS day_name, day(g) AS dom,
         CAST(month(g) AS INT) AS moy, CAST(quarter(g) AS INT) AS qoy, CAST(year(g) AS INT) AS yr
  FROM (SELECT unnest(generate_series(date_trunc('year', min(o_orderdate)), date_trunc('year', max(o_orderdate)) + INTERVAL 2 YEARS - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS g FROM orders))
"""

# Every order line with its order and item, amounts as exact decimals.
SALES = """
priced AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber % 3 AS channel, l_returnflag, l_shipdate,
         CAST(l_quantity AS INT) AS qty,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS list,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS coupon,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS tax
  FROM lineitem),
sales AS (
  SELECT f.*, CAST(list - coupon AS DECIMAL(18,4)) AS ext,
         CAST(CAST(p_retailprice AS DECIMAL(12,2)) * qty * 0.6 AS DECIMAL(18,4)) AS cost,
         CAST(list - coupon - CAST(p_retailprice AS DECIMAL(12,2)) * qty * 0.6 AS DECIMAL(18,4)) AS profit,
         o_custkey, CAST(o_orderdate AS DATE) AS sold,
         (o_custkey + l_suppkey) % (SELECT count(*) FROM customer) AS ship_addr
  FROM priced f JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)
"""

STORES = """
stores AS (
  SELECT s_suppkey, s_name, n_name AS state, r_name AS county, lpad(CAST(s_nationkey AS VARCHAR), 5, '0') AS zip
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""

PEOPLE = """
people AS (
  SELECT c_custkey, c_name, split_part(c_name, '#', 1) AS first_name, split_part(c_name, '#', 2) AS last_name,
         CASE WHEN c_acctbal < 0 THEN 'Dr.' ELSE 'Mx.' END AS salutation,
         CASE WHEN c_acctbal > 5000 THEN 'Y' ELSE 'N' END AS preferred,
         c_custkey % 10 AS deps, c_custkey % 5 AS cars, c_mktsegment AS segment,
         n_name AS city, lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS zip
  FROM customer JOIN nation ON c_nationkey = n_nationkey)
"""


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(v.strip() for v in views)


ORACLES = {
    "tpc_q1": with_views(SALES, STORES, """
back AS (SELECT o_custkey, l_suppkey, sum(ext) AS amt FROM sales JOIN stores ON l_suppkey = s_suppkey
         WHERE l_returnflag = 'R' AND year(l_shipdate) = 2000 AND state = 'NATION_3' GROUP BY ALL)
""") + """
SELECT c_name AS c_customer_id FROM back b JOIN customer ON o_custkey = c_custkey
WHERE CAST(amt AS DOUBLE) > 1.2 * (SELECT CAST(sum(amt) AS DOUBLE) / count(*) FROM back o WHERE o.l_suppkey = b.l_suppkey)
ORDER BY 1 LIMIT 100""",
    "tpc_q2": with_views(CALENDAR, SALES, """
wk AS (SELECT week,
  sum(CASE WHEN dow = 0 THEN ext ELSE 0 END) AS s0, sum(CASE WHEN dow = 1 THEN ext ELSE 0 END) AS s1,
  sum(CASE WHEN dow = 2 THEN ext ELSE 0 END) AS s2, sum(CASE WHEN dow = 3 THEN ext ELSE 0 END) AS s3,
  sum(CASE WHEN dow = 4 THEN ext ELSE 0 END) AS s4, sum(CASE WHEN dow = 5 THEN ext ELSE 0 END) AS s5,
  sum(CASE WHEN dow = 6 THEN ext ELSE 0 END) AS s6
  FROM sales JOIN cal ON sold = d_date WHERE channel <> 0 GROUP BY week),
a AS (SELECT wk.* FROM wk JOIN cal USING (week) WHERE yr = 2000),
b AS (SELECT wk.* FROM wk JOIN cal USING (week) WHERE yr = 2001)
""") + "SELECT CAST(a.week AS INT) AS d_week_seq1, " + ", ".join(
        f"CAST(a.s{n} AS DOUBLE) / NULLIF(CAST(b.s{n} AS DOUBLE), 0) AS {d}_ratio"
        for n, d in enumerate(("sun", "mon", "tue", "wed", "thu", "fri", "sat"))
    ) + " FROM a JOIN b ON a.week = b.week - 53 ORDER BY 1",
    "tpc_q3": with_views(CALENDAR, SALES) + """
SELECT yr AS d_year, CAST(split_part(p_brand, '#', 2) AS INT) AS brand_id, p_brand AS brand, CAST(sum(ext) AS DOUBLE) AS sum_agg
FROM sales JOIN cal ON sold = d_date JOIN part ON l_partkey = p_partkey
WHERE p_size = 10 AND moy = 11 GROUP BY 1, 2, 3 ORDER BY d_year, sum(ext) DESC, brand_id LIMIT 100""",
    "tpc_q4": with_views(CALENDAR, SALES, STORES, """
yt AS MATERIALIZED (SELECT o_custkey AS c, yr, county, CAST(sum(list - cost - coupon + ext) AS DOUBLE) / 2 AS tot
  FROM sales JOIN cal ON sold = d_date JOIN stores ON l_suppkey = s_suppkey WHERE yr IN (1999, 2000) GROUP BY ALL),
g AS MATERIALIZED (SELECT a.c, b.tot / a.tot AS growth FROM yt a JOIN yt b USING (c) WHERE a.yr = 1999 AND b.yr = 2000 AND a.tot > 0)
""") + """
SELECT c_name AS customer_id, split_part(c_name, '#', 1) AS customer_first_name, split_part(c_name, '#', 2) AS customer_last_name
FROM g AS cat JOIN g AS st USING (c) JOIN g AS web USING (c) JOIN customer ON c = c_custkey
WHERE cat.growth > st.growth AND cat.growth > web.growth ORDER BY 1, 2, 3 LIMIT 100""",
    "tpc_q5": with_views(SALES, STORES, """
sr AS (
  SELECT channel, l_suppkey, l_partkey, sold AS d, ext AS s, profit AS p, 0 AS r, 0 AS l FROM sales
  UNION ALL SELECT channel, l_suppkey, l_partkey, CAST(l_shipdate AS DATE), 0, 0, ext, tax FROM sales WHERE l_returnflag = 'R' AND channel <> 2
  UNION ALL SELECT 2, w.l_suppkey, w.l_partkey, CAST(b.l_shipdate AS DATE), 0, 0, b.ext, b.tax
    FROM sales b LEFT JOIN sales w ON b.l_partkey = w.l_partkey AND b.l_orderkey = w.l_orderkey AND w.channel = 2
    WHERE b.l_returnflag = 'R' AND b.channel = 2),
named AS (
  SELECT CASE channel WHEN 0 THEN 'store channel' WHEN 1 THEN 'catalog channel' ELSE 'web channel' END AS channel,
         CASE channel WHEN 0 THEN 'store' || s_name WHEN 1 THEN 'catalog_page' || p_brand ELSE 'web_site' || n_name END AS id, s, r, p - l AS net
  FROM sr LEFT JOIN stores ON l_suppkey = s_suppkey LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN nation ON l_suppkey % 25 = n_nationkey
  WHERE d BETWEEN DATE '2000-08-23' AND DATE '2000-08-23' + INTERVAL 14 DAYS)
""") + """
SELECT channel, id, CAST(sum(s) AS DOUBLE) AS total_sales, CAST(sum(r) AS DOUBLE) AS total_returns, CAST(sum(net) AS DOUBLE) AS total_profit
FROM named GROUP BY ROLLUP (channel, id) ORDER BY channel NULLS FIRST, id NULLS FIRST LIMIT 100""",
    "tpc_q19": with_views(SALES, STORES, PEOPLE) + """
SELECT CAST(split_part(p_brand, '#', 2) AS INT) AS brand_id, p_brand AS brand, p_size AS i_manufact_id,
       'Manufact#' || p_size AS i_manufact, CAST(sum(ext) AS DOUBLE) AS ext_price
FROM sales JOIN part ON l_partkey = p_partkey JOIN stores s ON l_suppkey = s_suppkey JOIN people c ON o_custkey = c_custkey
WHERE p_partkey % 10 = 8 AND sold BETWEEN DATE '1998-11-01' AND DATE '1998-11-30' AND c.zip <> s.zip
GROUP BY 1, 2, 3, 4 ORDER BY sum(ext) DESC, 2, 1, 3, 4 LIMIT 100""",
    "tpc_q27": with_views(SALES, STORES, PEOPLE) + """
SELECT printf('Item#%09d', l_partkey) AS i_item_id, state AS s_state, CAST(grouping(state) AS INT) AS g_state,
       CAST(sum(qty) AS DOUBLE) / count(*) AS agg1, CAST(sum(list) AS DOUBLE) / count(*) AS agg2,
       CAST(sum(coupon) AS DOUBLE) / count(*) AS agg3, CAST(sum(ext) AS DOUBLE) / count(*) AS agg4
FROM sales JOIN stores ON l_suppkey = s_suppkey JOIN people ON o_custkey = c_custkey
WHERE year(sold) = 2000 AND state IN ('NATION_3', 'NATION_7', 'NATION_11') AND c_custkey % 2 = 0 AND segment = 'BUILDING'
GROUP BY ROLLUP (i_item_id, state) ORDER BY 1 NULLS FIRST, 2 NULLS FIRST LIMIT 100""",
    "tpc_q34": with_views(CALENDAR, SALES, STORES, PEOPLE, """
dn AS (SELECT l_orderkey, o_custkey, count(*) AS cnt
  FROM sales JOIN cal ON sold = d_date JOIN stores ON l_suppkey = s_suppkey JOIN people ON o_custkey = c_custkey
  WHERE (dom BETWEEN 1 AND 3 OR dom BETWEEN 25 AND 28) AND segment IN ('BUILDING', 'MACHINERY') AND cars > 0
    AND CASE WHEN cars > 0 THEN CAST(deps AS DOUBLE) / cars END > 1.2
    AND yr IN (1999, 2000, 2001) AND county IN ('ASIA', 'EUROPE', 'AMERICA') GROUP BY 1, 2)
""") + """
SELECT last_name AS c_last_name, first_name AS c_first_name, salutation AS c_salutation, preferred AS c_preferred_cust_flag,
       l_orderkey AS ss_ticket_number, cnt
FROM dn JOIN people ON o_custkey = c_custkey WHERE cnt BETWEEN 3 AND 4 ORDER BY 1, 2, 3, 4 DESC, 5""",
    "tpc_q46": with_views(CALENDAR, SALES, STORES, PEOPLE, """
dn AS (SELECT l_orderkey, o_custkey, ship_addr, a.city AS bought_city, sum(coupon) AS amt, sum(profit) AS gain
  FROM sales JOIN cal ON sold = d_date JOIN stores ON l_suppkey = s_suppkey
  JOIN people h ON o_custkey = h.c_custkey JOIN people a ON ship_addr = a.c_custkey
  WHERE (h.deps = 4 OR h.cars = 3) AND dow IN (6, 0) AND yr IN (1999, 2000, 2001) AND state IN ('NATION_3', 'NATION_7')
  GROUP BY 1, 2, 3, 4)
""") + """
SELECT last_name AS c_last_name, first_name AS c_first_name, city AS ca_city, bought_city, l_orderkey AS ss_ticket_number,
       CAST(amt AS DOUBLE) AS amt, CAST(gain AS DOUBLE) AS profit
FROM dn JOIN people ON o_custkey = c_custkey WHERE city <> bought_city
ORDER BY last_name, first_name, city, bought_city, l_orderkey, dn.amt, gain LIMIT 100""",
    "tpc_q67": with_views(CALENDAR, SALES, STORES, """
cube AS (SELECT p_type AS i_category, p_size AS i_class, p_brand AS i_brand, p_name AS i_product_name,
    yr AS d_year, qoy AS d_qoy, moy AS d_moy, s_name AS s_store_id, sum(ext * qty) AS total
  FROM sales JOIN cal ON sold = d_date JOIN stores ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
  WHERE month_seq BETWEEN 1200 AND 1211
  GROUP BY ROLLUP (p_type, p_size, p_brand, p_name, yr, qoy, moy, s_name)),
ranked AS (SELECT *, rank() OVER (PARTITION BY i_category ORDER BY total DESC) AS r FROM cube)
""") + """
SELECT i_category, i_class, i_brand, i_product_name, d_year, d_qoy, d_moy, s_store_id,
       CAST(total AS DOUBLE) AS sumsales, CAST(r AS INT) AS rk FROM ranked WHERE r <= 100
ORDER BY i_category NULLS FIRST, i_class NULLS FIRST, i_brand NULLS FIRST, i_product_name NULLS FIRST, d_year NULLS FIRST,
         d_qoy NULLS FIRST, d_moy NULLS FIRST, s_store_id NULLS FIRST, total, r LIMIT 100""",
    "tpc_q72": with_views(CALENDAR, SALES, """
inv AS (SELECT l_partkey AS item, l_suppkey % 2 AS wh, yr, sum(qty) AS n FROM sales JOIN cal ON sold = d_date
  WHERE qoy = 1 AND yr BETWEEN 1999 AND 2001 GROUP BY ALL)
""") + """
SELECT printf('Item#%09d', a.item) AS i_item_desc, r_name AS w_warehouse_name,
       CAST(a.n AS BIGINT) AS inv_quantity_on_hand_1, CAST(b.n AS BIGINT) AS inv_quantity_on_hand_2, CAST(c.n AS BIGINT) AS inv_quantity_on_hand_3,
       a.yr AS d1_year, 1 AS d1_moy, 1 AS d1_dom, b.yr AS d2_year, 1 AS d2_moy, 1 AS d2_dom, c.yr AS d3_year, 1 AS d3_moy, 1 AS d3_dom
FROM inv a JOIN inv b ON a.item = b.item AND a.wh = b.wh AND a.n < b.n
JOIN inv c ON b.item = c.item AND b.wh = c.wh AND b.n < c.n JOIN region ON a.wh = r_regionkey
WHERE a.yr = 1999 AND b.yr = 2000 AND c.yr = 2001 ORDER BY 1, 2 LIMIT 100""",
    "tpc_q95": with_views(SALES, PEOPLE, """
multi AS (SELECT DISTINCT a.l_orderkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey % 5 <> b.l_suppkey % 5)
""") + """
SELECT count(DISTINCT l_orderkey) AS order_count, CAST(sum(tax) AS DOUBLE) AS total_shipping_cost, CAST(sum(profit) AS DOUBLE) AS total_net_profit
FROM sales JOIN people ON ship_addr = c_custkey JOIN nation ON l_suppkey % 25 = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1999-02-01' AND DATE '1999-02-01' + INTERVAL 60 DAYS
  AND city IN ('NATION_3', 'NATION_7') AND r_name = 'ASIA' AND l_orderkey IN (SELECT l_orderkey FROM multi)
  AND l_orderkey IN (SELECT l_orderkey FROM lineitem JOIN multi USING (l_orderkey) WHERE l_returnflag = 'R')""",
}

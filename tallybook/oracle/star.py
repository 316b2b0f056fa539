"""DuckDB twins of the star-schema views and business questions."""

from tallybook.oracle.retail import CALENDAR

PEOPLE = """
cust AS (SELECT c_custkey AS customer_id, c_custkey // 2 AS uid, lpad(CAST(c_custkey % 400 AS VARCHAR), 5, '0') AS zip,
  n_name AS city, r_name AS state, CAST(c_acctbal AS DECIMAL(12,2)) AS bal
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
person AS (SELECT * FROM cust QUALIFY row_number() OVER (PARTITION BY uid ORDER BY customer_id) = 1)
"""

PRODUCTS = """
prod AS (SELECT p_partkey AS pid, p_type AS cat,
  CASE p_type WHEN 'ECONOMY' THEN 'economy_furniture' WHEN 'MEDIUM' THEN 'health_beauty' WHEN 'PROMO' THEN 'promo_gifts'
    WHEN 'LARGE' THEN 'large_furniture' WHEN 'SMALL' THEN 'small_appliances' ELSE p_type END AS cat_en, p_name, p_brand, p_size FROM part)
"""

ORDERS = """
ord AS (SELECT o_orderkey AS oid, o_custkey,
  CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'approved' ELSE 'processing' END AS status,
  o_orderdate AS bought,
  o_orderdate + to_hours(o_orderkey % 50) + to_minutes(o_orderkey % 60) AS approved,
  o_orderdate + to_days(CAST(o_orderkey % 6 AS INT)) AS carried,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_days(CAST(o_orderkey * 7 % 41 AS INT)) + to_hours(o_orderkey % 24) END AS arrived,
  o_orderdate + to_days(21) AS due FROM orders)
"""

PAYMENTS = """
pay AS (SELECT o_orderkey AS oid, CAST(CAST(o_totalprice AS DECIMAL(12,2)) * 0.50 AS DECIMAL(18,4)) AS paid,
  CAST(1 + (o_orderkey + k) % 10 AS INT) AS inst, ['boleto', 'credit_card', 'voucher'][(o_orderkey + k) % 3 + 1] AS kind
  FROM orders, range(1, 3) t(k) WHERE k <= 1 + o_orderkey % 2),
pagg AS (SELECT oid, sum(paid) AS total_paid, max(inst) AS inst, min(kind) AS kind FROM pay GROUP BY oid)
"""

FACT = """
fact AS (SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id, l_suppkey AS seller_id,
    uid AS customer_id, zip AS customer_zip_code, kind AS payment_type, inst AS payment_installments,
    CAST(strftime(bought, '%Y%m%d') AS INT) AS order_date_key, CAST(strftime(approved, '%Y%m%d') AS INT) AS approved_date_key,
    CAST(strftime(l_shipdate, '%Y%m%d') AS INT) AS shipping_limit_date_key, CAST(strftime(carried, '%Y%m%d') AS INT) AS carrier_delivery_date_key,
    CAST(strftime(arrived, '%Y%m%d') AS INT) AS customer_delivery_date_key, CAST(strftime(due, '%Y%m%d') AS INT) AS estimated_delivery_date_key,
    strftime(bought, '%Y-%m-%d') AS order_date, strftime(approved, '%Y-%m-%d') AS approved_date, strftime(carried, '%Y-%m-%d') AS carrier_delivery_date,
    strftime(arrived, '%Y-%m-%d') AS customer_delivery_date, strftime(due, '%Y-%m-%d') AS estimated_delivery_date,
    CAST(year(bought) AS INT) AS order_year, CAST(quarter(bought) AS INT) AS order_quarter, CAST(month(bought) AS INT) AS order_month,
    monthname(bought) AS order_month_name, strftime(bought, '%Y-%m') AS order_year_month, dayname(bought) AS order_day_name,
    CASE WHEN dayofweek(bought) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend_order,
    CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
    CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS freight_value,
    total_paid AS total_payment_value,
    CAST(date_diff('day', CAST(bought AS DATE), CAST(arrived AS DATE)) AS INT) AS delivery_days,
    CAST(date_diff('day', CAST(due AS DATE), CAST(arrived AS DATE)) AS INT) AS delivery_variance_days,
    date_diff('hour', bought, approved) AS approval_hours,
    CASE WHEN status = 'delivered' THEN 1 ELSE 0 END AS is_delivered,
    CASE WHEN arrived IS NULL THEN NULL WHEN arrived > due THEN 1 ELSE 0 END AS is_late,
    CASE WHEN arrived IS NULL THEN 'Pending' WHEN arrived <= due THEN 'On Time' ELSE 'Late' END AS delivery_status,
    status AS order_status
  FROM lineitem JOIN ord ON l_orderkey = ord.oid LEFT JOIN cust ON o_custkey = cust.customer_id LEFT JOIN pagg ON l_orderkey = pagg.oid)
"""


def using(*views: str) -> str:
    return "WITH " + ",\n".join(v.strip() for v in views)


STAR = using(PEOPLE, PRODUCTS, ORDERS, PAYMENTS, FACT)
UNFULFILLED = """, waiting AS (SELECT city, count(DISTINCT o_custkey) AS n FROM ord JOIN cust ON o_custkey = customer_id WHERE arrived IS NULL GROUP BY city)"""
RANKED = "count(*) OVER () AS tot, row_number() OVER (ORDER BY delivery_days) AS rn"


def position(p: str, value: str) -> str:
    return f"CAST(max(CASE WHEN rn = ceil({p} * tot) THEN {value} END) AS DOUBLE)"


ORACLES = {
    "star_date": using(CALENDAR) + """
SELECT CAST(strftime(d_date, '%Y%m%d') AS INT) AS date_key, strftime(d_date, '%Y-%m-%d') AS date, yr AS year, qoy AS quarter,
  moy AS month_number, monthname(d_date) AS month_name, strftime(d_date, '%Y-%m') AS year_month, CAST(dom AS INT) AS day_of_month,
  CAST(dow + 1 AS INT) AS day_of_week, day_name, CAST(dayofyear(d_date) AS INT) AS day_of_year,
  CASE WHEN dow IN (0, 6) THEN 1 ELSE 0 END AS is_weekend FROM cal""",
    "star_customers": using(PEOPLE) + """
SELECT uid AS customer_id, zip AS customer_zip_code, city AS customer_city, state AS customer_state FROM person""",
    "star_products": using(PRODUCTS) + """
SELECT pid AS product_id, cat AS product_category, cat_en AS product_category_english, CAST(length(p_name) AS INT) AS product_name_length,
  CAST(length(p_name || p_brand) AS INT) AS product_description_length, p_size % 5 AS product_photos_count, p_size * 10 AS product_weight_g,
  p_size + 5 AS product_length_cm, p_size + 2 AS product_height_cm, p_size + 1 AS product_width_cm FROM prod""",
    "star_sellers": """
SELECT s_suppkey AS seller_id, lpad(CAST(s_suppkey % 400 AS VARCHAR), 5, '0') AS seller_zip_code, n_name AS seller_city, r_name AS seller_state
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "star_geography": using(PEOPLE) + """
SELECT zip AS zip_code, max(city) AS city, max(state) AS state,
  CAST(sum(CAST(bal * 0.001 AS DECIMAL(12,5))) AS DOUBLE) / count(*) AS latitude,
  CAST(sum(CAST(bal * -0.002 AS DECIMAL(12,5))) AS DOUBLE) / count(*) AS longitude FROM cust GROUP BY zip""",
    "star_payments_agg": using(PAYMENTS) + """
SELECT oid AS order_id, CAST(total_paid AS DOUBLE) AS total_payment_value, inst AS payment_installments, kind AS payment_type FROM pagg""",
    "star_sales": STAR + """
SELECT * REPLACE (CAST(price AS DOUBLE) AS price, CAST(freight_value AS DOUBLE) AS freight_value,
  CAST(total_payment_value AS DOUBLE) AS total_payment_value), CAST(fact.price + fact.freight_value AS DOUBLE) AS line_total FROM fact""",
    "star_rowcounts": STAR + ", " + CALENDAR + """
SELECT 'Sales' AS view, count(*) AS rows FROM fact UNION ALL SELECT 'Date', count(*) FROM cal
UNION ALL SELECT 'Customers', count(DISTINCT uid) FROM cust UNION ALL SELECT 'Products', count(*) FROM part
UNION ALL SELECT 'Sellers', count(*) FROM supplier UNION ALL SELECT 'Geography', count(DISTINCT zip) FROM cust""",
    "bq_category_revenue": STAR + """
SELECT CAST(sum(price) AS DOUBLE) AS total_furniture_revenue FROM fact JOIN prod ON product_id = pid WHERE cat_en LIKE '%furniture%'""",
    "bq_category_year_revenue": STAR + """
SELECT cat_en AS product_category, CAST(sum(price) AS DOUBLE) AS total_revenue FROM fact JOIN prod ON product_id = pid
WHERE cat_en = 'health_beauty' AND order_year = 1997 GROUP BY 1""",
    "bq_top_city_delivered": STAR + """
SELECT city AS customer_city, count(DISTINCT order_id) AS delivered_order_count FROM fact JOIN person ON fact.customer_id = uid
WHERE is_delivered = 1 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""",
    "bq_top_customer_spend": STAR + """
SELECT uid AS customer_id, city AS customer_city, state AS customer_state, zip AS customer_zip_code,
  CAST(sum(total_payment_value) AS DOUBLE) AS total_amount_spent
FROM fact JOIN person ON fact.customer_id = uid GROUP BY 1, 2, 3, 4 ORDER BY sum(total_payment_value) DESC, 1 LIMIT 1""",
    "bq_late_zip_percentiles": STAR + f""",
worst AS (SELECT customer_zip_code AS z FROM fact WHERE is_late = 1 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
numbered AS (SELECT delivery_days, {RANKED} FROM fact WHERE customer_zip_code = (SELECT z FROM worst) AND delivery_days IS NOT NULL)
SELECT (SELECT z FROM worst) AS customer_zip, count(*) AS delivery_count, round(CAST(sum(delivery_days) AS DOUBLE) / count(*), 2) AS avg_days,
  {position('0.5', 'delivery_days')} AS median_days, {position('0.95', 'delivery_days')} AS p95_days, {position('0.99', 'delivery_days')} AS p99_days FROM numbered""",
    "bq_top_city_percentiles": STAR + f""",
gone AS (SELECT city, delivery_days FROM fact JOIN person ON fact.customer_id = uid WHERE is_delivered = 1 AND delivery_days IS NOT NULL),
numbered AS (SELECT city, delivery_days, {RANKED} FROM gone WHERE city = (SELECT city FROM gone GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))
SELECT city AS customer_city, count(*) AS n_delivered_orders, round(CAST(sum(delivery_days) AS DOUBLE) / count(*), 2) AS avg_delivery_days,
  {position('0.5', 'delivery_days')} AS median_delivery_days, {position('0.95', 'delivery_days')} AS p95_delivery_days,
  {position('0.99', 'delivery_days')} AS p99_delivery_days FROM numbered GROUP BY 1""",
    "bq_median_of_medians": STAR + f""",
n1 AS (SELECT product_id, price, row_number() OVER (PARTITION BY product_id ORDER BY price) AS rn, count(*) OVER (PARTITION BY product_id) AS tot
  FROM fact JOIN prod ON product_id = pid WHERE cat_en = 'health_beauty'),
n2 AS (SELECT product_id, max(CASE WHEN rn = ceil(0.5 * tot) THEN price END) AS med FROM n1 GROUP BY 1),
n3 AS (SELECT med, row_number() OVER (ORDER BY med) AS rn, count(*) OVER () AS tot FROM n2)
SELECT {position('0.5', 'med')} AS catalog_median_price FROM n3""",
    "bq_approved_orders": "SELECT count(*) AS approved_orders FROM orders WHERE o_orderstatus = 'O'",
    "bq_customers_in_city": """
SELECT count(DISTINCT c_custkey) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3'""",
    "bq_top3_cities": """
SELECT lower(n_name) AS customer_city, count(DISTINCT c_custkey) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3""",
    "bq_top3_customers_in_city": STAR + """
SELECT o_custkey AS customer_id, lower(city) AS customer_city, count(*) AS approved_orders FROM ord JOIN cust ON o_custkey = customer_id
WHERE status = 'approved' AND city = 'NATION_3' GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 3""",
    "bq_unfulfilled_city": STAR + UNFULFILLED + """
SELECT lower(city) AS customer_city, n AS unfulfilled_customers FROM waiting ORDER BY n DESC, 1 LIMIT 1""",
    "bq_unfulfilled_city_ties": STAR + UNFULFILLED + """
SELECT lower(city) AS customer_city, n AS unfulfilled_customers FROM waiting WHERE n = (SELECT max(n) FROM waiting)""",
    "bq_unfulfilled_count": STAR + " SELECT count(*) AS unfulfilled_orders FROM ord WHERE arrived IS NULL",
}

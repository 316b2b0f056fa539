"""DuckDB twins of the small analytics jobs."""

TREE = """
WITH nodes AS (SELECT 'r' || r_regionkey AS id, r_name AS name, NULL AS parent_id FROM region
  UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey FROM nation),
served AS (SELECT DISTINCT 'n' || c_nationkey AS node_id, c_mktsegment AS leaf FROM customer WHERE c_nationkey % 6 <> 0),
tree AS (SELECT n.id, n.name, coalesce(p.name, 'None') AS parent_name,
  coalesce((SELECT string_agg(leaf, ', ' ORDER BY leaf) FROM served WHERE node_id = n.id), 'No Workspaces') AS leaves
  FROM nodes n LEFT JOIN nodes p ON n.parent_id = p.id)
"""

#: Partial dependence by its definition: the trees' value for each cell with all rows' other values.
INTERACTIONS = """
WITH v AS (SELECT l_quantity AS x0, l_discount AS x1, l_tax AS x2, CAST(count(*) AS DOUBLE) AS n FROM lineitem WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_tax IS NOT NULL GROUP BY ALL),
p01 AS (SELECT a.x0, a.x1, b.x2, a.n AS w, b.n AS m FROM (SELECT x0, x1, sum(n) AS n FROM v GROUP BY ALL) a, (SELECT x2, sum(n) AS n FROM v GROUP BY ALL) b),
p02 AS (SELECT a.x0, b.x1, a.x2, a.n AS w, b.n AS m FROM (SELECT x0, x2, sum(n) AS n FROM v GROUP BY ALL) a, (SELECT x1, sum(n) AS n FROM v GROUP BY ALL) b),
p12 AS (SELECT b.x0, a.x1, a.x2, a.n AS w, b.n AS m FROM (SELECT x1, x2, sum(n) AS n FROM v GROUP BY ALL) a, (SELECT x0, sum(n) AS n FROM v GROUP BY ALL) b),
p0 AS (SELECT a.x0, b.x1, b.x2, a.n AS w, b.n AS m FROM (SELECT x0, sum(n) AS n FROM v GROUP BY ALL) a, (SELECT x1, x2, sum(n) AS n FROM v GROUP BY ALL) b),
p1 AS (SELECT b.x0, a.x1, b.x2, a.n AS w, b.n AS m FROM (SELECT x1, sum(n) AS n FROM v GROUP BY ALL) a, (SELECT x0, x2, sum(n) AS n FROM v GROUP BY ALL) b),
p2 AS (SELECT b.x0, b.x1, a.x2, a.n AS w, b.n AS m FROM (SELECT x2, sum(n) AS n FROM v GROUP BY ALL) a, (SELECT x0, x1, sum(n) AS n FROM v GROUP BY ALL) b),
e AS (SELECT *, CASE WHEN x0 <= 24.5 THEN CASE WHEN x1 <= 0.045 THEN 3.0 WHEN x2 <= 0.035 THEN 1.5 ELSE 2.25 END ELSE CASE WHEN x1 <= 0.025 THEN 8.0 ELSE 5.5 END END
  + CASE WHEN x2 <= 0.055 THEN CASE WHEN x0 <= 10.5 THEN -1.0 ELSE 0.5 END ELSE CASE WHEN x0 <= 40.5 THEN 0.75 ELSE 2.0 END END
  + CASE WHEN x1 <= 0.075 THEN 0.25 WHEN x1 <= 0.095 THEN -0.5 ELSE -1.25 END AS y FROM (
  SELECT '01' AS s, x0 AS a, x1 AS b, * FROM p01 UNION ALL SELECT '02', x0, x2, * FROM p02 UNION ALL SELECT '12', x1, x2, * FROM p12
  UNION ALL SELECT '0', x0, NULL, * FROM p0 UNION ALL SELECT '1', x1, NULL, * FROM p1 UNION ALL SELECT '2', x2, NULL, * FROM p2)),
f AS (SELECT s, a, b, any_value(w) AS w, sum(CAST(y AS DOUBLE) * m) / sum(m) AS f FROM e GROUP BY ALL),
c AS (SELECT s, a, b, w, f - sum(w * f) OVER (PARTITION BY s) / sum(w) OVER (PARTITION BY s) AS f FROM f),
j AS (SELECT t.s, t.w, t.f AS both_, t.f - u.f - v.f AS extra FROM c t JOIN c u ON u.s = t.s[1] AND u.a = t.a JOIN c v ON v.s = t.s[2] AND v.a = t.b WHERE length(t.s) = 2)
SELECT ['l_quantity', 'l_discount', 'l_tax'][CAST(s[1] AS INT) + 1] AS feature_a, ['l_quantity', 'l_discount', 'l_tax'][CAST(s[2] AS INT) + 1] AS feature_b,
  round(sqrt(sum(w * extra * extra) / sum(w * both_ * both_)), 9) AS h FROM j GROUP BY s"""

ORACLES = {
    "an_tree_interactions": INTERACTIONS,
    "an_elementwise": """
WITH v AS (SELECT l_orderkey, l_linenumber, l_quantity + l_discount AS x FROM lineitem)
SELECT *, round(x * sin(10 * x) + tan(34 * x) + ln(x), 6) AS y FROM v""",
    "an_param_grid": """
SELECT p1, p2, round(sin(p1) + ln(p2), 9) AS metric
FROM (SELECT DISTINCT l_quantity AS p1 FROM lineitem), (SELECT DISTINCT p_size AS p2 FROM part)""",
    "an_run_duration": """
SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first_start, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_start, count(*) AS runs,
  date_sub('second', min(ts), max(ts)) AS seconds FROM events""",
    "an_hierarchy": TREE + "SELECT * FROM tree",
    "an_hierarchy_edges": TREE + """
SELECT p.name AS source, n.name AS target FROM nodes n JOIN nodes p ON n.parent_id = p.id
UNION SELECT n.name, leaf FROM nodes n JOIN served ON node_id = n.id""",
    "an_workspace_filter": """
SELECT DISTINCT 'w' || o_custkey AS id FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey NOT IN (7, 11)""",
    "an_results_export": """
SELECT o_orderpriority, CAST(count(*) AS VARCHAR) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS VARCHAR) AS value, count(*) AS json_orders
FROM orders GROUP BY 1""",
}

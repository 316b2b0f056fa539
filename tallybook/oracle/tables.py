"""DuckDB twins of the table operations and health reports."""

from tallybook.oracle.documents import PAIRS

PEOPLE = "people AS (SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, c_acctbal AS balance FROM customer)"
NEW = "newcomers AS (SELECT s_suppkey + 1000000000 AS id, s_name AS name, s_nationkey AS nation, s_acctbal AS balance FROM supplier)"
LOG = """
WITH log AS (SELECT 'table_' || (user_id % 40) AS "table", event_id AS version, ts,
  CASE event_type WHEN 'view' THEN 'WRITE' WHEN 'click' THEN 'MERGE' WHEN 'signup' THEN 'OPTIMIZE' WHEN 'purchase' THEN 'DELETE' WHEN 'error' THEN 'VACUUM END' END AS operation,
  regexp_extract(props, '(\\d+)', 1) AS files FROM events)
"""
STAMP = "'%Y-%m-%d %H:%M:%S.%f'"
AS_OF = "TIMESTAMP '2024-02-15 12:00:00'"


def last(kind: str) -> str:
    return f"max(ts) FILTER (operation = '{kind}')"


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

ORACLES = {
    # Each table is one file, so its fewest, most and median rows a file are its rows.
    "th_rows_per_file": "SELECT *, num_rows AS min_rows, num_rows AS max_rows, num_rows AS median_rows FROM ("
    + " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS num_rows FROM {t}" for t in TABLES) + ")",
    "tb_create": f"WITH {PEOPLE} SELECT * FROM people",
    "tb_append": f"WITH {PEOPLE}, {NEW} SELECT * FROM people UNION ALL SELECT * FROM newcomers",
    "tb_update": f"""WITH {PEOPLE} SELECT id, CASE WHEN nation = 3 AND id % 10 <> 0 THEN upper(name) ELSE name END AS name, nation,
  CASE WHEN nation = 3 AND id % 10 <> 0 THEN 0.0::DOUBLE ELSE balance END AS balance FROM people""",
    "tb_delete": f"WITH {PEOPLE} SELECT * FROM people WHERE NOT (balance < 0 AND id % 10 <> 0)",
    "tb_merge": f"""WITH {PEOPLE} SELECT id, CASE WHEN id % 2 = 0 THEN name ELSE 'new ' || name END AS name, nation,
  CASE WHEN id % 3 = 0 THEN nation * 1.5::DOUBLE ELSE balance END AS balance FROM people WHERE id % 2 = 0 OR id % 3 = 0""",
    "tb_schema_evolve": f"""WITH {PEOPLE}, {NEW} SELECT *, CAST(NULL AS VARCHAR) AS country FROM people UNION ALL SELECT *, 'USA' FROM newcomers""",
    "tb_history_counts": LOG + "SELECT operation, count(*) AS operations FROM log GROUP BY 1",
    "tb_history_times": LOG + f"SELECT strftime(ts, {STAMP}) AS timestamp, operation FROM log ORDER BY ts DESC, 2",
    "tb_history_filter": LOG + f"SELECT version, strftime(ts, {STAMP}) AS timestamp, files AS num_files FROM log WHERE operation = 'DELETE'",
    "tb_incremental_refresh": """
WITH o AS (SELECT o_orderkey, o_totalprice, CAST(year(o_orderdate) AS INT) AS o_year FROM orders)
SELECT o_orderkey, CASE WHEN o_year IN (1998, 1999) THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, o_year FROM o
WHERE o_year NOT IN (1998, 1999) OR o_orderkey % 2 = 0""",
    "tb_typed_select": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders",
    "tb_infer_types": """
WITH f AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 5),
l AS (SELECT o_orderkey AS pos, 'order_key' AS column_name, CAST(o_orderkey AS VARCHAR) AS v FROM f
  UNION ALL SELECT o_orderkey, 'customer', CAST(o_custkey AS VARCHAR) FROM f WHERE o_orderkey % 7 <> 0
  UNION ALL SELECT o_orderkey, 'ordered', strftime(o_orderdate, '%Y-%m-%d') FROM f WHERE o_orderkey > 1
  UNION ALL SELECT o_orderkey, 'price', CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) FROM f
  UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM f
  UNION ALL SELECT o_orderkey, 'row_number', CAST(o_orderkey AS VARCHAR) FROM f),
first AS (SELECT column_name, arg_min(v, pos) AS v FROM l GROUP BY 1)
SELECT column_name, CASE WHEN TRY_CAST(v AS DOUBLE) IS NOT NULL THEN 'Number' WHEN TRY_CAST(v AS DATE) IS NOT NULL THEN 'Date' ELSE 'Text' END AS column_type FROM first""",
    "tb_declared_types": """
SELECT o_orderkey AS order_key, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_custkey AS DOUBLE) END AS customer,
  CASE WHEN o_orderkey > 1 THEN strftime(o_orderdate, '%Y-%m-%d') END AS ordered, o_totalprice AS price, CAST(NULL AS VARCHAR) AS shipped,
  o_orderpriority AS priority FROM orders""",
    "tb_clean_column_names": "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders",
    "th_operation_metrics": LOG + f"""
, m AS (SELECT "table", count(*) AS total_operations, count(*) FILTER (operation = 'WRITE') AS write_operations, count(*) FILTER (operation = 'MERGE') AS merge_operations,
  count(*) FILTER (operation = 'DELETE') AS delete_operations, count(*) FILTER (operation = 'OPTIMIZE') AS optimize_count,
  count(*) FILTER (operation = 'VACUUM END') AS vacuum_count, {last('WRITE')} AS lw, {last('OPTIMIZE')} AS lo, {last('VACUUM END')} AS lv,
  count(*) FILTER (operation = 'WRITE' AND CAST(files AS INT) < 5) AS small FROM log GROUP BY 1)
SELECT "table", total_operations, write_operations, merge_operations, delete_operations, optimize_count, vacuum_count,
  date_sub('day', lw, {AS_OF}) AS days_since_write, date_sub('day', lo, {AS_OF}) AS days_since_optimize, date_sub('day', lv, {AS_OF}) AS days_since_vacuum,
  CAST(small AS DOUBLE) / greatest(1, write_operations) * 100 AS small_writes_percentage,
  strftime(lw, {STAMP}) AS last_write, strftime(lo, {STAMP}) AS last_optimize, strftime(lv, {STAMP}) AS last_vacuum FROM m""",
    "th_maintenance_plan": LOG + f"""
, l AS (SELECT "table", {last('OPTIMIZE')} AS o, {last('VACUUM END')} AS v FROM log
  WHERE NOT ("table" = 'table_7' AND operation = 'OPTIMIZE') AND ts < TIMESTAMP '2024-01-18' GROUP BY 1),
d AS (SELECT *, o IS NULL OR {AS_OF} - o > INTERVAL 7 DAYS AS od, v IS NULL OR {AS_OF} - v > INTERVAL 30 DAYS AS vd FROM l)
SELECT "table", strftime(o, {STAMP}) AS optimize_last_run, strftime(v, {STAMP}) AS vacuum_last_run, od AS optimize_due, vd AS vacuum_due,
  CASE WHEN od THEN 'Optimize is due' ELSE 'Optimize skipped - last run was within 7 days' END AS optimize_message,
  CASE WHEN vd THEN 'Vacuum is due' ELSE 'Vacuum skipped - last run was within 30 days' END AS vacuum_message FROM d""",
    "th_column_drift": PAIRS + """
, l AS (SELECT DISTINCT 't' || (k % 14) AS t, unnest(json_keys(actual)) AS c FROM pairs),
r AS (SELECT DISTINCT 't' || (k % 14) AS t, unnest(json_keys(predicted)) AS c FROM pairs),
tabs AS (SELECT DISTINCT t FROM l)
SELECT t AS "table",
  coalesce((SELECT string_agg(c, ',' ORDER BY c) FROM l WHERE l.t = tabs.t AND (t, c) NOT IN (SELECT t, c FROM r)), '') AS left_only_columns,
  coalesce((SELECT string_agg(c, ',' ORDER BY c) FROM r WHERE r.t = tabs.t AND (t, c) NOT IN (SELECT t, c FROM l)), '') AS right_only_columns,
  NOT EXISTS (SELECT 1 FROM l WHERE l.t = tabs.t AND (t, c) NOT IN (SELECT t, c FROM r)) AND NOT EXISTS (SELECT 1 FROM r WHERE r.t = tabs.t AND (t, c) NOT IN (SELECT t, c FROM l)) AS is_match
FROM tabs""",
}

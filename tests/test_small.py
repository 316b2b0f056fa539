"""Percentiles, sums, dashboard, star edge cases, analytics, runner, plans."""

import datetime as dt
import math
import random

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tallybook import registry
from tallybook.functions.numeric import exact_sum, total
from tallybook.operators import analytics as an
from tallybook.operators import dashboard, star
from tallybook.operators.interactions import fit, interactions
from tallybook.operators.percentile import median, nearest_rank
from tallybook.runner import run_suite
from tallybook.sources.retail import Retail
from tallybook.sources.tables import Tables


def test_nearest_rank_against_sorting(spark):
    chance = random.Random(3)
    groups = {
        "hot": [chance.choice([7, chance.randint(-50_000, 50_000)]) for _ in range(3000)],
        "same": [5] * 40, "one": [-9], "two": [1, 10_000_000],
    }
    rows = [(g, v) for g, values in groups.items() for v in values] + [("one", None)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(6)
    got = {r.g: r for r in nearest_rank(df, ["g"], "v", {"p50": "0.5", "p95": "0.95", "p99": "0.99"}).collect()}
    middle = {r.g: r.median for r in median(df, ["g"], "v").collect()}
    for g, values in groups.items():
        values, n = sorted(values), len(values)
        assert got[g].n_values == n
        for name, p in (("p50", 50), ("p95", 95), ("p99", 99)):
            assert got[g][name] == values[max(1, -(-p * n // 100)) - 1]
        assert middle[g] == (values[(n - 1) // 2] + values[n // 2]) / 2


def test_nearest_rank_without_keys_and_with_weights(spark):
    df = spark.createDataFrame([(1, 3), (2, 1), (9, 6)], "v int, w long")
    row = nearest_rank(df, [], "v", {"m": "0.5"}, weight="w").first()
    assert (row.n_values, row.m) == (10, 9)


def test_exact_sum_beyond_long(spark):
    big = 9_000_000_000_000_000_000
    df = spark.createDataFrame([(big,), (big,), (big,), (-big,), (-7,), (5,)], "v long")
    assert str(df.agg(exact_sum("v")).first()[0]) == f"{(2 * big - 2) // 10000}.{(2 * big - 2) % 10000:04d}"
    assert spark.createDataFrame([(12_345_600,)], "v long").agg(total("v")).first()[0] == 1234.56
    assert df.filter("v is null").agg(total("v")).first()[0] is None


SALES = [
    ("2025-07-03", 1, "Desk", 2, "100.25"), ("2025-07-31", 2, "Lamp", 1, "50.00"),
    ("2025-08-01", 3, "Desk", 11, "112.10"), ("2025-08-31", 4, "Lamp", 3, "0.40"),
]


@pytest.fixture(scope="module")
def sales(spark):
    rows = spark.createDataFrame([(d, o, c, u, p) for d, o, c, u, p in SALES], "d string, order_id int, category string, units int, p string")
    return rows.select(
        F.col("d").cast("timestamp_ntz").alias("timestamp"), "order_id", "category", "units", F.col("p").cast("decimal(9,2)").alias("unit_price")
    )


def test_dashboard(sales):
    august = dashboard.kpis(sales, 2025, 8).first()
    assert (august.total_revenue, august.total_orders, august.total_revenue_text, august.average_order_value_text) == (
        1234.30, 2, "$1,234.30", "$617.15",
    )
    assert {r.category: r.total_revenue for r in dashboard.category_revenue(sales, 2025, 7).collect()} == {"Desk": 200.5, "Lamp": 50.0}
    assert [r.order_id for r in dashboard.sales_trend(sales, 2025, 7).collect()] == [1, 2]
    empty = dashboard.kpis(sales, 2024, 8).first()
    assert (empty.total_revenue, empty.total_orders, empty.total_revenue_text, empty.average_order_value_text) == (0.0, 0, "$0.00", "$0.00")


def stamp(text):
    return None if text is None else dt.datetime.fromisoformat(text)


def test_star_edge_cases(spark):
    order_columns = (
        "order_id int, customer_id int, order_status string, order_purchase_timestamp timestamp_ntz, order_approved_at timestamp_ntz, "
        "order_delivered_carrier_date timestamp_ntz, order_delivered_customer_date timestamp_ntz, order_estimated_delivery_date timestamp_ntz"
    )
    orders = spark.createDataFrame(
        [
            (1, 1, "shipped", stamp("2024-01-07 00:59:00"), stamp("2024-01-07 01:01:00"), None, None, stamp("2024-01-10")),
            (2, 2, "delivered", stamp("2024-01-08 10:00:00"), None, None, stamp("2024-01-10"), stamp("2024-01-10")),
            (3, 9, "delivered", stamp("2024-01-08 10:00:00"), None, None, stamp("2024-01-10 00:00:01"), stamp("2024-01-10")),
        ],
        order_columns,
    )
    items = spark.createDataFrame(
        [(1, 1, 1, 1, 100, 5, stamp("2024-01-09")), (1, 2, 1, 1, 200, 5, stamp("2024-01-09")), (2, 1, 1, 1, 1, 0, stamp("2024-01-09")), (3, 1, 1, 1, 1, 0, stamp("2024-01-09"))],
        "order_id int, order_item_id int, product_id int, seller_id int, price long, freight_value long, shipping_limit_date timestamp_ntz",
    )
    customers = spark.createDataFrame(
        [(2, "u", "00002", "b", "s"), (1, "u", "00001", "a", "s")],
        "customer_id int, customer_unique_id string, customer_zip_code_prefix string, customer_city string, customer_state string",
    )
    payments = spark.createDataFrame([(1, 40, 3, "voucher"), (1, 60, 1, "card")], "order_id int, payment_value long, payment_installments int, payment_type string")
    fact = {(r.order_id, r.order_item_id): r for r in star.sales_fact(items, orders, customers, payments).collect()}
    assert len(fact) == 4 and len(fact[1, 1]) == 37
    first = fact[1, 1]
    assert (first.is_late, first.delivery_status, first.approval_hours, first.is_weekend_order) == (None, "Pending", 1, 1)
    assert (int(first.total_payment_value), first.payment_installments, first.payment_type) == (100, 3, "card")
    assert int(fact[1, 2].total_payment_value) == 100
    assert (fact[2, 1].is_late, fact[2, 1].delivery_status, fact[2, 1].payment_type) == (0, "On Time", None)
    assert (fact[3, 1].is_late, fact[3, 1].delivery_status, fact[3, 1].customer_id) == (1, "Late", None)
    people = star.customer_dimension(customers).collect()
    assert [(p.customer_id, p.customer_city) for p in people] == [("u", "A")]
    products = spark.createDataFrame([(1, "x"), (2, "y")], "product_id int, product_category_name string")
    for name in ("name_lenght", "description_lenght", "photos_qty", "weight_g", "length_cm", "height_cm", "width_cm"):
        products = products.withColumn(f"product_{name}", F.lit(1))
    translation = spark.createDataFrame([("x", "ex")], "product_category_name string, product_category_name_english string")
    shown = {r.product_id: r.product_category_english for r in star.product_dimension(products, translation).collect()}
    assert shown == {1: "ex", 2: "y"}


def test_elementwise_forms_agree(spark):
    df = spark.range(1, 2000).select((F.col("id") / 7).alias("x"))
    apart = df.select(F.max(F.abs(an.elementwise(F.col("x")) - an.elementwise_udf("x")))).first()[0]
    assert apart < 1e-6


def test_parameter_grid(spark):
    grid = an.parameter_grid(spark.range(1, 4).select(F.col("id").alias("p1")), spark.range(1, 5).select(F.col("id").alias("p2")))
    got = {(r.p1, r.p2): r.metric for r in grid.collect()}
    assert len(got) == 12 and got[3, 4] == pytest.approx(math.sin(3) + math.log(4))


def test_interaction_ranks_first(spark):
    rows = spark.range(2000).select(*[((F.xxhash64("id", F.lit(n)) % 1000 + 1000) / 2000).alias(f"x{n}") for n in range(3)])
    data = rows.withColumn("y", F.col("x0") * F.col("x1") + F.col("x2"))
    model = fit(data, ["x0", "x1", "x2"], "y", trees=8)
    best = interactions(model, data, ["x0", "x1", "x2"]).first()
    assert (best.feature_a, best.feature_b) == ("x0", "x1")


def test_interactions_equal_row_by_row(spark):
    """The weighted cells give the averages over all pairs of rows."""
    rows = [(float(k % 5), float(k * 7 % 11), float(k % 3)) for k in range(40)]
    data = spark.createDataFrame(rows, "a double, b double, c double").withColumn("y", F.col("a") * F.col("b") + F.col("c"))
    model = fit(data, ["a", "b", "c"], "y", trees=4)

    def mean(**fixed):
        total = [model.predict(Vectors.dense([fixed.get(n, v) for n, v in zip("abc", row)])) for row in rows]
        return sum(total) / len(total)

    ones = {(n, v): mean(**{n: v}) for n, at in zip("abc", range(3)) for v in {r[at] for r in rows}}
    twos = {(r[0], r[1]): mean(a=r[0], b=r[1]) for r in rows}
    fa, fb, fab = ([ones["a", r[0]] for r in rows], [ones["b", r[1]] for r in rows], [twos[r[0], r[1]] for r in rows])
    fa, fb, fab = ([x - sum(f) / len(f) for x in f] for f in (fa, fb, fab))
    wanted = math.sqrt(sum((z - x - y) ** 2 for x, y, z in zip(fa, fb, fab)) / sum(z * z for z in fab))
    got = {(r.feature_a, r.feature_b): r.h for r in interactions(model, data, ["a", "b", "c"]).collect()}
    assert got["a", "b"] == pytest.approx(wanted)


def test_hierarchy(spark):
    nodes = spark.createDataFrame([("a", "Root", None), ("b", "Child", "a"), ("c", "Orphan", "zz")], "id string, name string, parent_id string")
    leaves = spark.createDataFrame([("b", "w2, w3"), ("b", "w1"), ("b", "w1")], "node_id string, leaf string")
    tree = an.hierarchy(nodes, leaves)
    got = {r.name: (r.parent_name, r.leaves) for r in tree.collect()}
    assert got == {"Root": ("None", "No Workspaces"), "Child": ("Root", "w1, w2, w3"), "Orphan": ("None", "No Workspaces")}
    edges = {tuple(r) for r in an.hierarchy_edges(nodes, leaves).collect()}
    assert edges == {("Root", "Child"), ("Child", "w1"), ("Child", "w2, w3")}


def test_read_questions(spark, tmp_path):
    (tmp_path / "q.csv").write_text('question,query\n"a, ""b""","select 1\nfrom t"\nplain,x\n')
    got = [tuple(r) for r in an.read_questions(spark, str(tmp_path / "q.csv")).collect()]
    assert got == [('a, "b"', "select 1\nfrom t"), ("plain", "x")]


def test_runner_records_failures(spark, tmp_path):
    def broken(spark, sf_dir):
        raise ValueError("no such table")

    report = run_suite(spark, "-", {"good": lambda s, d: s.range(3), "bad": broken}, "c1", str(tmp_path / "times"))
    got = {r.query_name: r for r in report.collect()}
    assert got["good"].duration > 0 and got["good"].error is None
    assert got["bad"].duration == -1.0 and "no such table" in got["bad"].error
    assert spark.read.option("header", True).csv(str(tmp_path / "times")).count() == 2


def test_date_ranges_reach_the_scan(spark, sf_dir):
    plan = registry.all_queries()["tpc_q19"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "CartesianProduct" not in plan


def test_lines_meet_stores_without_a_shuffle(spark, tmp_path):
    """The rows of a join with ``store()``; few suppliers do not make Spark shuffle all lines."""
    tables = {
        "region": ([(0, "ASIA"), (1, "EUROPE")], "r_regionkey int, r_name string"),
        "nation": ([(n, f"NATION_{n}", n % 3) for n in range(5)] + [(None, "NOWHERE", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "supplier": ([(k, f"Supplier#{k}", k % 6) for k in range(20)] + [(7, "Supplier#twin", 1), (None, "none", 1), (21, None, None)], "s_suppkey long, s_name string, s_nationkey int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    r = Retail(Tables(spark, str(tmp_path)))
    lines = spark.createDataFrame([(k, k % 25 if k % 9 else None) for k in range(200)], "line int, ss_store_sk long").repartition(3)
    columns = ["s_store_id", "s_state", "s_county", "s_zip"]
    for where in (None, F.col("s_state").isin("NATION_1", "NATION_3")):
        found = r.at_store(lines, *columns, where=where)
        stores = r.store() if where is None else r.store().filter(where)
        wanted = lines.join(stores, F.col("ss_store_sk") == F.col("s_store_sk")).select("line", "ss_store_sk", "s_store_sk", *columns)
        assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect()))
        assert found.count() > 30
        assert "SortMergeJoin" not in found._jdf.queryExecution().sparkPlan().toString()

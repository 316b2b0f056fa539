"""Small analytics jobs over the order and event tables, and the suite runner."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.operators import analytics as an
from tallybook.operators.interactions import Node, fit, interactions, leaves_of_trees
from tallybook.plans import retail
from tallybook.runner import run_suite
from tallybook.session import scratch_path
from tallybook.sources.tables import Tables
from tallybook.streaming.transactions import uniform

FEATURES = ["x0", "x1", "x2"]


def an_elementwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = Tables(spark, sf_dir)["lineitem"]
    x = F.col("l_quantity") + F.col("l_discount")
    return lines.select("l_orderkey", "l_linenumber", x.alias("x"), F.round(an.elementwise(x), 6).alias("y"))


def an_param_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities and part sizes as the two parameter lists."""
    t = Tables(spark, sf_dir)
    grid = an.parameter_grid(t["lineitem"].select(F.col("l_quantity").alias("p1")), t["part"].select(F.col("p_size").alias("p2")))
    return grid.withColumn("metric", F.round("metric", 9))


def an_run_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = an.run_duration(Tables(spark, sf_dir)["events"], "ts")
    return span.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("first_start", "last_start")})


def an_feature_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactions in line items: the target is x0 * x1 + x2 plus small noise."""
    lines = Tables(spark, sf_dir)["lineitem"]
    row = F.xxhash64(*lines.columns)
    data = lines.select(
        row.alias("row"),
        (F.col("l_quantity") / 50).alias("x0"),
        (F.col("l_discount") * 10).alias("x1"),
        (F.col("l_tax") * 12.5).alias("x2"),
    ).withColumn("y", F.col("x0") * F.col("x1") + F.col("x2") + 0.1 * (uniform(F.col("row"), 1, 42) - 0.5))
    model = fit(data, FEATURES, "y")
    return interactions(model, data, FEATURES)


#: Trees as a pricing team might write them down: the part of a line's price that its quantity, discount and tax decide.
PRICE_TREES: list[Node] = [
    ("l_quantity", 24.5, ("l_discount", 0.045, 3.0, ("l_tax", 0.035, 1.5, 2.25)), ("l_discount", 0.025, 8.0, 5.5)),
    ("l_tax", 0.055, ("l_quantity", 10.5, -1.0, 0.5), ("l_quantity", 40.5, 0.75, 2.0)),
    ("l_discount", 0.075, 0.25, ("l_discount", 0.095, -0.5, -1.25)),
]


def an_tree_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactions of the given trees over all line items."""
    columns = ["l_quantity", "l_discount", "l_tax"]
    found = interactions(leaves_of_trees(PRICE_TREES, columns), Tables(spark, sf_dir)["lineitem"], columns)
    return found.withColumn("h", F.round("h", 9))


def tree(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Regions and nations as nodes, the market segments served as their leaves."""
    regions = t["region"].select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent_id"))
    nations = t["nation"].select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"))
    served = t["customer"].filter(F.col("c_nationkey") % 6 != 0).select(F.concat(F.lit("n"), "c_nationkey").alias("node_id"), F.col("c_mktsegment").alias("leaf"))
    return regions.unionByName(nations), served


def an_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.hierarchy(*tree(Tables(spark, sf_dir)))


def an_hierarchy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.hierarchy_edges(*tree(Tables(spark, sf_dir)))


def an_workspace_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of orders as workspaces, urgent orders as dedicated capacity."""
    orders = Tables(spark, sf_dir)["orders"].select(
        F.concat(F.lit("w"), "o_custkey").alias("id"), (F.col("o_orderpriority") == "1-URGENT").alias("on_dedicated")
    )
    return an.movable(orders, "w7", "w11")


def an_results_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order counts and values per priority, exported and read back from both files."""
    path = scratch_path(spark, "export")
    results = Tables(spark, sf_dir)["orders"].groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(12,2)")).alias("value")
    )
    an.export_results(results, path, ["o_orderpriority"])
    table = spark.read.option("header", True).csv(f"{path}/csv")
    nested = spark.read.schema("key struct<o_orderpriority string>, result struct<orders long, value string>").json(f"{path}/json")
    flat = nested.select("key.o_orderpriority", F.col("result.orders").alias("json_orders"))
    return table.join(flat, "o_orderpriority")


def tpc_runner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run times of the decision-support suite over this data."""
    return run_suite(spark, sf_dir, retail.SUITE, "registered")


SUITE = {
    f.__name__: f
    for f in (
        an_elementwise, an_param_grid, an_run_duration, an_feature_interactions, an_tree_interactions, an_hierarchy, an_hierarchy_edges,
        an_workspace_filter, an_results_export, tpc_runner,
    )
}

"""Small analytics jobs: element-wise functions, grids, hierarchies, exports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NO_PARENT, NO_CHILDREN = "None", "No Workspaces"


def elementwise(x: Column) -> Column:
    """x * sin(10x) + tan(34x) + ln(x) as built-in functions."""
    return x * F.sin(10 * x) + F.tan(34 * x) + F.ln(x)


@F.pandas_udf(T.DoubleType())
def elementwise_udf(x: pd.Series) -> pd.Series:
    """The same function in numpy, for comparison with the built-in form."""
    return x * np.sin(10 * x) + np.tan(34 * x) + np.log(x)


def parameter_grid(first: DataFrame, second: DataFrame) -> DataFrame:
    """Every combination of the distinct values of two parameters with its metric."""
    each = first.distinct().crossJoin(second.distinct())
    return each.withColumn("metric", F.sin(F.col(first.columns[0])) + F.ln(F.col(second.columns[0])))


def run_duration(runs: DataFrame, start: str) -> DataFrame:
    """Time from the first to the last start, in seconds."""
    span = runs.agg(F.min(start).alias("first_start"), F.max(start).alias("last_start"), F.count(F.lit(1)).alias("runs"))
    return span.withColumn("seconds", F.timestamp_diff("SECOND", "first_start", "last_start"))


def hierarchy(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """Each node with its parent's name and its leaves in one text.

    ``nodes`` has ``id, name, parent_id``; ``leaves`` has ``node_id, leaf``. The
    leaf list is part of the result, so a node's distinct leaves must fit a row.
    """
    parents = nodes.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name"))
    listed = (
        leaves.distinct().groupBy(F.col("node_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_list("leaf")), ", ").alias("leaves"))
    )
    return (
        nodes.join(parents, "parent_id", "left")
        .join(listed, "id", "left")
        .select("id", "name", F.coalesce("parent_name", F.lit(NO_PARENT)).alias("parent_name"), F.coalesce("leaves", F.lit(NO_CHILDREN)).alias("leaves"))
    )


def hierarchy_edges(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """Edges parent -> node and node -> leaf, by name, of the rows that ``hierarchy`` takes."""
    named = nodes.select(F.col("id").alias("from_id"), F.col("name").alias("source"))
    up = nodes.join(named, F.col("parent_id") == F.col("from_id")).select("source", F.col("name").alias("target"))
    down = leaves.distinct().join(named, F.col("node_id") == F.col("from_id")).select("source", F.col("leaf").alias("target"))
    return up.unionByName(down).distinct()


def movable(workspaces: DataFrame, target: str, current: str) -> DataFrame:
    """Distinct workspaces on dedicated capacity that are neither target nor current."""
    wanted = F.col("on_dedicated") & (F.col("id") != target) & (F.col("id") != current)
    return workspaces.filter(wanted).select("id").distinct()


def export_results(df: DataFrame, path: str, sort: list[str]) -> None:
    """Results as sorted CSV with header and as nested JSON lines."""
    ordered = df.orderBy(*sort)
    ordered.write.option("header", True).csv(f"{path}/csv")
    ordered.select(F.to_json(F.struct(F.struct(*sort).alias("key"), F.struct(*[c for c in df.columns if c not in sort]).alias("result"))).alias("value")).write.text(f"{path}/json")


def read_questions(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Question set: CSV with header and quoted multi-line fields, all text; all of it unless limited."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows if limit is None else rows.limit(limit)

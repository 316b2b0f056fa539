"""Exact order statistics that never sort a whole group in one task."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BLOCK = 4096


def values_at(
    df: DataFrame,
    keys: list[str],
    value: str,
    positions: dict[str, Callable[[Column], Column]],
    weight: str | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Value at each position of every group's ascending order.

    ``value`` must be integral (use cents for money); ``positions`` gives a place
    counted from one as a function of the group's row count; ``weight`` names a
    column that says how often a row counts. Rows are counted per value, values
    are gathered into blocks of ``block`` neighbours, and only the blocks that
    hold a wanted position are looked at value by value.
    """
    keys = keys or ["_all"]
    source = df if "_all" not in keys else df.withColumn("_all", F.lit(0))
    counts = (
        source.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("long").alias("_value"))
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_n"))
        .withColumn("_block", F.floor(F.col("_value") / block))
    )
    by_block = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    blocks = (
        counts.groupBy(*keys, "_block")
        .agg(F.sum("_n").alias("_in"))
        .withColumn("_before", F.coalesce(F.sum("_in").over(by_block), F.lit(0)))
        .withColumn("_total", F.sum("_in").over(whole))
    )
    needed = F.lit(False)
    for name, position in positions.items():
        blocks = blocks.withColumn(f"_at_{name}", position(F.col("_total")))
        needed = needed | F.col(f"_at_{name}").between(F.col("_before") + 1, F.col("_before") + F.col("_in"))
    in_block = W.partitionBy(*keys, "_block").orderBy("_value").rowsBetween(W.unboundedPreceding, 0)
    reached = (
        counts.join(blocks.filter(needed), [*keys, "_block"])
        .withColumn("_upto", F.col("_before") + F.sum("_n").over(in_block))
        .withColumn("_from", F.col("_upto") - F.col("_n") + 1)
    )
    picks = [
        F.max(F.when(F.col(f"_at_{n}").between(F.col("_from"), F.col("_upto")), F.col("_value"))).alias(n)
        for n in positions
    ]
    return reached.groupBy(*keys).agg(F.max("_total").alias("n_values"), *picks).drop("_all")


def nearest_rank(df: DataFrame, keys: list[str], value: str, probs: dict[str, str], weight: str | None = None) -> DataFrame:
    """Value at position ``ceil(p * n)`` of each group, per named probability."""

    def place(p: str) -> Callable[[Column], Column]:
        share = F.lit(Decimal(p)).cast("decimal(6,4)")
        return lambda total: F.greatest(F.ceil(share * total.cast("decimal(20,0)")).cast("long"), F.lit(1).cast("long"))

    return values_at(df, keys, value, {name: place(p) for name, p in probs.items()}, weight)


def median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Middle value of each group, the mean of the two middle ones for even counts."""
    middle = {
        "low": lambda total: F.floor((total + 1) / 2),
        "high": lambda total: F.floor(total / 2) + 1,
    }
    found = values_at(df, keys, value, middle)
    return found.select(*keys, "n_values", ((F.col("low") + F.col("high")) / 2).alias("median"))

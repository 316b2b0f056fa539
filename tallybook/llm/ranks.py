"""Places of rows in a total order, without one task or group that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.common import written

ROWS_A_RANGE = 500_000


def ranked(df: DataFrame, order: list[Column], group: str, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """``df`` with ``at``, the place from 0 within ``group`` (never null), and ``total``, the group's rows.

    Rows are dealt into ranges of (group, order) and sorted there; the sizes of the ranges
    before a row are added to its place in its own. Ties take places in the order in which
    they are stored, so that a key that many rows share is dealt to many ranges too.
    ``df`` should be a written table: it is read twice, and ties must keep their order.
    The ranges are written, since a place must not change when a lost task is run again.
    """
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // rows_a_range + 1)
    keys = [F.col(group), *order, F.col("_tie")]
    dealt = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    placed = written(dealt.drop("_tie").withColumn("_row", F.monotonically_increasing_id()), "ranges")
    placed = placed.withColumn("_range", F.shiftright("_row", 33))
    runs = placed.groupBy(group, "_range").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy(group)
    before = F.sum("_n").over(whole.orderBy("_range")) - F.col("_n")
    runs = runs.select(group, "_range", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("total"))
    return placed.join(runs, [group, "_range"]).withColumn("at", F.col("_row") + F.col("_shift")).drop("_row", "_range", "_shift")

"""Timed run of a query suite."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.session import scratch_path

RESULT_SCHEMA = "query_name string, duration double, configuration string, error string"
FAILED = -1.0


def run_suite(
    spark: SparkSession,
    sf_dir: str,
    queries: dict[str, Callable[[SparkSession, str], DataFrame]],
    configuration: str,
    csv_path: str | None = None,
) -> DataFrame:
    """Run every query, write its result, and report seconds per query.

    A failing query is reported with duration -1 and its error; the rest go on.
    """
    results = scratch_path(spark, "suite")
    rows = []
    for name, query in queries.items():
        start = time.perf_counter()
        try:
            query(spark, sf_dir).write.mode("overwrite").parquet(f"{results}/{name}")
            rows.append((name, time.perf_counter() - start, configuration, None))
        except Exception as error:  # one failing query must not end the run
            rows.append((name, FAILED, configuration, str(error)))
    report = spark.createDataFrame(rows, RESULT_SCHEMA)
    if csv_path:
        report.orderBy(F.col("query_name")).coalesce(1).write.mode("overwrite").option("header", True).csv(csv_path)
    return report

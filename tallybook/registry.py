"""All registered queries and their DuckDB twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

TOPICS = ("retail", "star", "reports", "evaluation", "retrieval", "documents", "tables", "logs", "streams", "analytics")


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for topic in TOPICS:
        found.update(importlib.import_module(f"tallybook.plans.{topic}").SUITE)
    return found


def all_oracles() -> dict[str, str]:
    found: dict[str, str] = {}
    for topic in TOPICS:
        found.update(importlib.import_module(f"tallybook.oracle.{topic}").ORACLES)
    return found

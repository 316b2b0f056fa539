"""Comparison of a Spark result with its DuckDB twin."""

from __future__ import annotations

import math

import duckdb
from pyspark.sql import DataFrame

from tallybook.sources.tables import TABLE_NAMES

KINDS = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
}


def cell(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def ordered(names: list[str], rows: list[tuple]) -> list[tuple]:
    places = [names.index(n) for n in sorted(names)]
    picked = [tuple(cell(row[p]) for p in places) for row in rows]
    return sorted(picked, key=lambda r: tuple((v is None, str(v)) for v in r))


def differences(ours: DataFrame, our_rows: list, relation) -> str | None:
    theirs = [d[0] for d in relation.description]
    kinds = {d[0]: str(d[1]) for d in relation.description}
    if sorted(ours.columns) != sorted(theirs):
        return f"columns {sorted(ours.columns)} vs {sorted(theirs)}"
    their_rows = relation.fetchall()
    if len(our_rows) != len(their_rows):
        return f"rows {len(our_rows)} vs {len(their_rows)}"
    left, right = ordered(ours.columns, our_rows), ordered(theirs, their_rows)
    unequal = [(a, b) for a, b in zip(left, right) if a != b]
    if unequal:
        return f"{len(unequal)} of {len(left)} rows differ, first:\n   spark {unequal[0][0]}\n   sql   {unequal[0][1]}"
    wrong = [f"{n}: {t} vs {kinds[n]}" for n, t in ours.dtypes if KINDS.get(t, t) != kinds[n]]
    return "types " + "; ".join(wrong) if wrong else None


def duck_views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    """In-process DuckDB with every table as a view."""
    duck = duckdb.connect()
    for name in TABLE_NAMES:
        duck.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return duck

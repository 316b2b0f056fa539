"""Changes to tables as DataFrame functions, snapshots and typed columns."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.session import written

# Declared type names and the detected kinds of columns.
DECLARED = {"Int64": "bigint", "Double": "double", "String": "string", "DateTime": "timestamp_ntz"}
DATE_TEXT = r"^\s*(\d{4}-\d{1,2}-\d{1,2}|\d{1,2}/\d{1,2}/\d{4})\s*$"
SNIFFED_ROWS = 5
#: Column of the rows that stand for a partition without rows.
GONE = "_gone"
TARGET_FILE_BYTES = 128 * 1024 * 1024
HISTORY_SCHEMA = "version long, timestamp timestamp_ntz, operation string, operationMetrics map<string,string>"


def append(current: DataFrame, extra: DataFrame) -> DataFrame:
    return current.unionByName(extra)


def append_evolving(current: DataFrame, extra: DataFrame) -> DataFrame:
    """Append rows that may bring new columns; older rows read them as NULL."""
    return current.unionByName(extra, allowMissingColumns=True)


def update_where(df: DataFrame, condition: Column, sets: dict[str, Column]) -> DataFrame:
    """Set columns where the condition holds; an unknown condition changes nothing."""
    kinds = dict(df.dtypes)
    changed = {name: F.when(condition, value.cast(kinds[name])).otherwise(F.col(name)).alias(name) for name, value in sets.items()}
    return df.select(*[changed.get(name, F.col(name)) for name in df.columns])


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """Drop rows where the condition holds; an unknown condition keeps the row."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def one_row_per_key(source: DataFrame, keys: list[str]) -> DataFrame:
    """The source itself, failing when a key occurs twice."""
    rest = [c for c in source.columns if c not in keys]
    packed = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest)).alias("_r"))
    twice = F.raise_error(F.lit(f"several source rows share a key ({', '.join(keys)})")).cast("boolean")
    return packed.filter(F.when(F.col("_n") > 1, twice).otherwise(True)).select(*keys, "_r.*")


def merge_upsert(target: DataFrame, source: DataFrame, keys: list[str], update_cols: list[str]) -> DataFrame:
    """Update some columns of matched rows, insert unmatched source rows.

    Updates are a left join and inserts an anti join against the target's keys:
    unlike one full join, both can be split when a key holds many target rows.
    """
    unique = one_row_per_key(source, keys)
    offered = unique.select(*keys, F.lit(True).alias("_matched"), *[F.col(c).alias(f"_s_{c}") for c in update_cols])

    def updated(name: str) -> Column:
        if name not in update_cols:
            return F.col(name)
        return F.when(F.col("_matched"), F.col(f"_s_{name}")).otherwise(F.col(name)).alias(name)

    kept = target.join(offered, keys, "left").select(*[updated(name) for name in target.columns])
    inserted = unique.join(target.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(inserted.select(*[c for c in target.columns if c in source.columns]), allowMissingColumns=True)


def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """Path, bytes and time of the data files below a folder; no content is read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet")
        .load(path)
        .select("path", "length", "modificationTime")
    )


def files_for(total_bytes: int, target_bytes: int = TARGET_FILE_BYTES) -> int:
    return max(1, math.ceil(total_bytes / target_bytes))


def compact(spark: SparkSession, path: str, new_path: str, target_bytes: int = TARGET_FILE_BYTES) -> DataFrame:
    """Rewrite a folder's rows into files of about ``target_bytes``.

    Returns one row with the file and row counts before and after.
    """
    size = file_listing(spark, path).agg(F.sum("length")).first()[0]
    spark.read.parquet(path).repartition(files_for(size, target_bytes)).write.parquet(new_path)

    def measured(where: str, tag: str) -> DataFrame:
        files = file_listing(spark, where).agg(F.count(F.lit(1)).alias(f"files_{tag}"))
        rows = spark.read.parquet(where).agg(F.count(F.lit(1)).alias(f"rows_{tag}"))
        return files.join(F.broadcast(rows))

    return measured(path, "before").join(F.broadcast(measured(new_path, "after")))


def write_snapshot(df: DataFrame, root: str, version: int, operation: str, metrics: dict[str, str] | None = None) -> DataFrame:
    """Write a version of a table beside the earlier ones and note it in the history."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{root}/v{version}")
    noted = F.create_map(*[F.lit(x) for pair in (metrics or {}).items() for x in pair]).cast("map<string,string>")
    row = spark.range(1).select(
        F.lit(version).cast("long").alias("version"),
        F.current_timestamp().cast("timestamp_ntz").alias("timestamp"),
        F.lit(operation).alias("operation"),
        noted.alias("operationMetrics"),
    )
    row.coalesce(1).write.mode("append").parquet(f"{root}/history")
    return spark.read.parquet(f"{root}/v{version}")


def history(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(HISTORY_SCHEMA).parquet(f"{root}/history")


def history_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("operation").agg(F.count(F.lit(1)).alias("operations"))


def history_times(log: DataFrame) -> DataFrame:
    """Time and operation, newest first."""
    return log.select("timestamp", "operation").orderBy(F.desc("timestamp"), "operation")


def history_filter(log: DataFrame, operation: str) -> DataFrame:
    return log.filter(F.col("operation") == operation).select("version", "timestamp", "operationMetrics")


def incremental_refresh(path: str, fresh: DataFrame, partition: str, start: int, end: int) -> DataFrame:
    """Replace the partitions in [start, end) by fresh rows, leaving the others alone.

    One write replaces all of them, and the fresh rows are computed for it alone. A partition that is
    held but gets no row would keep its old ones, so an anti join adds a row for each such partition
    that only says so (``GONE``); ``read_refreshed`` leaves those out.
    """
    spark = fresh.sparkSession
    in_range = (F.col(partition) >= start) & (F.col(partition) < end)
    rows = written(fresh.filter(in_range), "refresh")
    held = spark.read.parquet(path).filter(in_range).select(partition).distinct()
    stale = written(held.join(rows.select(partition).distinct(), partition, "left_anti").withColumn(GONE, F.lit(True)), "stale")
    whole = rows.withColumn(GONE, F.lit(None).cast("boolean")).unionByName(stale, allowMissingColumns=True)
    whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    return read_refreshed(spark, path, fresh.schema)


def read_refreshed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of a table that ``incremental_refresh`` has changed."""
    table = spark.read.schema(T.StructType([*schema.fields, T.StructField(GONE, T.BooleanType())])).parquet(path)
    return table.filter(F.col(GONE).isNull()).select(*schema.names)


def declared_kind(kind: T.DataType) -> str:
    if isinstance(kind, T.DateType):
        return "Date"
    if isinstance(kind, T.NumericType):
        return "Number"
    return "Text" if isinstance(kind, T.StringType) else "Other"


def infer_types(df: DataFrame, order: str, rows: int = SNIFFED_ROWS) -> DataFrame:
    """Date, Number, Text or Other per column, from the first rows.

    Text columns are judged by their first value that is present; columns
    without any value there are left out.
    """
    kinds = {f.name: declared_kind(f.dataType) for f in df.schema.fields}
    head = df.orderBy(order).limit(rows)
    texts = head.select(F.col(order).alias("_at"), *[F.col(c).cast("string").alias(c) for c in df.columns])
    long = texts.unpivot("_at", df.columns, "column_name", "value").filter(F.col("value").isNotNull())
    first = long.groupBy("column_name").agg(F.min_by("value", "_at").alias("value"))
    value = F.col("value")
    sniffed = (
        F.when(value.rlike(DATE_TEXT), "Date")
        .when(F.expr("try_cast(value AS double)").isNotNull(), "Number")
        .otherwise("Text")
    )
    known = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    declared = F.element_at(known, F.col("column_name"))
    return first.select("column_name", F.when(declared == "Text", sniffed).otherwise(declared).alias("column_type"))


def typed_select(df: DataFrame, kind: str) -> DataFrame:
    """Columns of one kind by their schema type; "All" keeps everything."""
    if kind == "All":
        return df
    return df.select(*[f.name for f in df.schema.fields if declared_kind(f.dataType) == kind])


def apply_declared_types(df: DataFrame, type_map: dict[str, str]) -> DataFrame:
    """Cast columns as declared.

    Integers with missing values become doubles; date columns without any value
    stay as they are. Which columns have missing or no values decides the schema, so it is looked
    up while the plan is built, for those columns alone: the search for a missing value ends at
    the first one, and only a column without any value is read whole.
    """

    def any_row(name: str, null: bool) -> bool:
        held = F.col(name).isNull() if null else F.col(name).isNotNull()
        return not df.select(name).filter(held).isEmpty()

    def cast(name: str) -> Column:
        declared = type_map.get(name)
        if declared not in DECLARED:
            return F.col(name)
        if declared == "DateTime" and not any_row(name, null=False):
            return F.col(name)
        if declared == "Int64" and any_row(name, null=True):
            return F.col(name).cast("double").alias(name)
        return F.col(name).cast(DECLARED[declared]).alias(name)

    return df.select(*[cast(name) for name in df.columns])


def clean_column_names(df: DataFrame) -> DataFrame:
    """Column names without table prefix and brackets: sales[amount] -> amount."""
    return df.toDF(*[re.sub(r"^[^\[]*\[|\]$", "", name) for name in df.columns])

"""Health of tables: files, history, due maintenance, column drift."""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions.numeric import count_if, ratio
from tallybook.operators.percentile import median
from tallybook.operators.tables import file_listing

# Limits of the health report and the maintenance rules.
MB = 1024 * 1024
SMALL_FILE_MB = 8
SMALL_WRITE_FILES = 5
OPTIMIZE_DAYS, VACUUM_DAYS = 7, 30


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Data files below a folder with their table: ``table`` or ``schema/table``."""
    base = urlparse(root).path.rstrip("/") + "/"
    relative = F.substring(F.col("path"), F.locate(base, F.col("path")) + len(base), F.length("path"))
    folders = F.split(relative, "/")
    two_levels = F.concat_ws("/", folders[0], F.get(folders, F.lit(1)))
    depth = F.size(F.filter(folders, lambda f: ~f.contains("=")))
    table = F.when(depth >= 3, two_levels).otherwise(F.regexp_replace(folders[0], r"\.parquet$", ""))
    return file_listing(spark, root).select(table.alias("table"), "path", "length", "modificationTime")


def file_size_stats(files: DataFrame, small_mb: int = SMALL_FILE_MB) -> DataFrame:
    """Files, total size (at least 1 MB), median size and share of small files."""
    sizes = files.withColumn("bytes", F.col("length").cast("long"))
    middle = median(sizes, ["table"], "bytes").select("table", F.floor(F.col("median") / MB).cast("int").alias("median_file_size_mb"))
    stats = sizes.groupBy("table").agg(
        F.count(F.lit(1)).alias("num_files"),
        F.greatest(F.lit(1), F.round(F.sum("bytes") / MB, 0)).cast("long").alias("size_mb"),
        (ratio(count_if(F.col("bytes") < small_mb * MB), F.count(F.lit(1))) * 100).alias("small_files_percentage"),
    )
    return stats.join(middle, "table")


def rows_per_file(counted: DataFrame) -> DataFrame:
    """Fewest, most and median rows of a table's files from ``table, path, num_rows``."""
    middle = median(counted, ["table"], "num_rows").select("table", F.floor("median").cast("long").alias("median_rows"))
    stats = counted.groupBy("table").agg(
        F.min("num_rows").alias("min_rows"), F.max("num_rows").alias("max_rows"), F.sum("num_rows").alias("num_rows")
    )
    return stats.join(middle, "table")


def count_file_rows(df: DataFrame, table: str) -> DataFrame:
    """Rows of each file of a table; no data column is read."""
    return (
        df.select(F.col("_metadata.file_path").alias("path"))
        .groupBy("path")
        .agg(F.count(F.lit(1)).alias("num_rows"))
        .select(F.lit(table).alias("table"), "path", "num_rows")
    )


def last_time(test: Column) -> Column:
    return F.max(F.when(test, F.col("timestamp")))


def operation_metrics(history: DataFrame, as_of: Column) -> DataFrame:
    """Operation counts, days since the last ones and share of small writes.

    One aggregation per table instead of one pass per operation.
    """
    kind = F.col("operation")
    written = F.try_element_at("operationMetrics", F.lit("numFiles")).try_cast("long")
    gathered = history.groupBy("table").agg(
        F.count(F.lit(1)).alias("total_operations"),
        count_if(kind == "WRITE").alias("write_operations"),
        count_if(kind == "MERGE").alias("merge_operations"),
        count_if(kind == "DELETE").alias("delete_operations"),
        count_if(kind == "OPTIMIZE").alias("optimize_count"),
        count_if(kind == "VACUUM END").alias("vacuum_count"),
        last_time(kind == "WRITE").alias("last_write"),
        last_time(kind == "OPTIMIZE").alias("last_optimize"),
        last_time(kind == "VACUUM END").alias("last_vacuum"),
        count_if((kind == "WRITE") & (written < SMALL_WRITE_FILES)).alias("small"),
    )

    def days_since(name: str) -> Column:
        return F.timestamp_diff("DAY", F.col(name), as_of).alias(f"days_since_{name.removeprefix('last_')}")

    writes = F.greatest(F.lit(1), F.col("write_operations"))
    return gathered.select(
        "*",
        days_since("last_write"),
        days_since("last_optimize"),
        days_since("last_vacuum"),
        (ratio(F.col("small"), writes) * 100).alias("small_writes_percentage"),
    ).drop("small")


def table_report(files: DataFrame, file_rows: DataFrame, history: DataFrame, shortcuts: DataFrame, as_of: Column) -> DataFrame:
    """One row per table with files, rows and operations, largest first."""
    parts = F.split("table", "/")
    has_schema = F.size(parts) > 1
    flagged = shortcuts.select(F.col("table_name"), F.lit(True).alias("is_shortcut")).distinct()
    return (
        file_size_stats(files)
        .join(rows_per_file(file_rows), "table", "left")
        .join(operation_metrics(history, as_of), "table", "left")
        .withColumn("schema_name", F.when(has_schema, parts[0]).otherwise(""))
        .withColumn("table_name", F.when(has_schema, F.get(parts, F.lit(1))).otherwise(parts[0]))
        .drop("table")
        .join(flagged, "table_name", "left")
        .withColumn("is_shortcut", F.coalesce("is_shortcut", F.lit(False)))
        .orderBy(F.desc("size_mb"), "schema_name", "table_name")
    )


def maintenance_plan(history: DataFrame, as_of: Column, optimize_days: int = OPTIMIZE_DAYS, vacuum_days: int = VACUUM_DAYS) -> DataFrame:
    """Which tables are due for file compaction or clean-up, and why not."""
    kind = F.col("operation")
    last = history.groupBy("table").agg(
        last_time(kind.contains("OPTIMIZE")).alias("optimize_last_run"),
        last_time(kind.contains("VACUUM") & ~kind.contains("OPTIMIZE")).alias("vacuum_last_run"),
    )

    def due(name: str, days: int) -> Column:
        run = F.col(name)
        return run.isNull() | (as_of > run + F.make_dt_interval(F.lit(days)))

    def message(is_due: Column, job: str, days: int) -> Column:
        return F.when(is_due, f"{job} is due").otherwise(f"{job} skipped - last run was within {days} days")

    optimize, vacuum = due("optimize_last_run", optimize_days), due("vacuum_last_run", vacuum_days)
    return last.select(
        "*",
        optimize.alias("optimize_due"),
        vacuum.alias("vacuum_due"),
        message(optimize, "Optimize", optimize_days).alias("optimize_message"),
        message(vacuum, "Vacuum", vacuum_days).alias("vacuum_message"),
    )


def unreferenced_files(inventory: DataFrame, referenced: DataFrame, older_than: Column) -> DataFrame:
    """Files on disk that the current snapshot does not list; nothing is deleted."""
    old = inventory.filter(F.col("modificationTime") < older_than)
    return old.join(referenced.select("path"), "path", "left_anti")


def column_drift(left_cols: DataFrame, right_cols: DataFrame) -> DataFrame:
    """Columns found on one side only, per table of the left side.

    Inputs are ``table, column`` rows; the lists are bounded by a table's width.
    """
    keys = ["table", "column"]
    left = left_cols.select(*keys).distinct().withColumn("_l", F.lit(True))
    right = right_cols.select(*keys).distinct().withColumn("_r", F.lit(True))
    only_left = F.collect_list(F.when(F.col("_r").isNull(), F.col("column")))
    only_right = F.collect_list(F.when(F.col("_l").isNull(), F.col("column")))
    drift = left.join(right, keys, "full").groupBy("table").agg(
        F.array_sort(only_left).alias("left_only_columns"), F.array_sort(only_right).alias("right_only_columns")
    )
    return drift.withColumn("is_match", (F.size("left_only_columns") == 0) & (F.size("right_only_columns") == 0))


def drift_summary(drift: DataFrame) -> DataFrame:
    return drift.agg(F.count(F.lit(1)).alias("tables"), count_if(~F.col("is_match")).alias("mismatched"))

"""Table operations, history and health over the order and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.operators import health, tables as tb
from tallybook.plans.documents import document_pairs
from tallybook.session import scratch_path
from tallybook.sources.tables import TABLE_NAMES, Tables

AS_OF = "2024-02-15 12:00:00"
REFRESH = (1998, 2000)
PIECES = 16
# Event types read as operations of a table history.
OPERATIONS = {"view": "WRITE", "click": "MERGE", "signup": "OPTIMIZE", "purchase": "DELETE", "error": "VACUUM END"}


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def people(t: Tables) -> DataFrame:
    return t["customer"].select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")
    )


def newcomers(t: Tables) -> DataFrame:
    return t["supplier"].select(
        (F.col("s_suppkey") + 1_000_000_000).alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")
    )


def tb_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.write_snapshot(people(Tables(spark, sf_dir)), scratch_path(spark, "create"), 0, "WRITE")


def tb_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return tb.append(people(t), newcomers(t))


def tb_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.when(F.col("id") % 10 != 0, F.col("nation"))
    return tb.update_where(people(Tables(spark, sf_dir)), known == 3, {"balance": F.lit(0.0), "name": F.upper("name")})


def tb_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.when(F.col("id") % 10 != 0, F.col("balance"))
    return tb.delete_where(people(Tables(spark, sf_dir)), known < 0)


def tb_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    everyone = people(Tables(spark, sf_dir))
    target = everyone.filter(F.col("id") % 2 == 0)
    source = everyone.filter(F.col("id") % 3 == 0).select(
        "id", F.concat(F.lit("new "), "name").alias("name"), "nation", (F.col("nation") * 1.5).alias("balance")
    )
    return tb.merge_upsert(target, source, ["id"], ["balance"])


def tb_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items written as many small files, then compacted."""
    scattered, packed = scratch_path(spark, "scattered"), scratch_path(spark, "packed")
    Tables(spark, sf_dir)["lineitem"].repartition(PIECES).write.parquet(scattered)
    return tb.compact(spark, scattered, packed)


def tb_schema_evolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a new column beside older files that lack it."""
    t, path = Tables(spark, sf_dir), scratch_path(spark, "evolve")
    people(t).write.parquet(path)
    newcomers(t).withColumn("country", F.lit("USA")).write.mode("append").parquet(path)
    return spark.read.option("mergeSchema", True).parquet(path)


def operation_log(t: Tables) -> DataFrame:
    """Events as the histories of forty tables."""
    names = F.create_map(*[F.lit(x) for pair in OPERATIONS.items() for x in pair])
    files = F.regexp_extract("props", r"(\d+)", 1)
    return t["events"].select(
        F.concat(F.lit("table_"), (F.col("user_id") % 40).cast("string")).alias("table"),
        F.col("event_id").alias("version"),
        F.col("ts").alias("timestamp"),
        F.element_at(names, F.col("event_type")).alias("operation"),
        F.create_map(F.lit("numFiles"), files).alias("operationMetrics"),
    )


def shown(stamp: str) -> Column:
    return F.date_format(stamp, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(stamp)


def tb_history_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.history_counts(operation_log(Tables(spark, sf_dir)))


def tb_history_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.history_times(operation_log(Tables(spark, sf_dir))).select(shown("timestamp"), "operation")


def tb_history_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tb.history_filter(operation_log(Tables(spark, sf_dir)), "DELETE")
    return found.select("version", shown("timestamp"), F.element_at("operationMetrics", "numFiles").alias("num_files"))


def tb_incremental_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by year; two years are replaced by doubled prices."""
    path = scratch_path(spark, "refresh")
    orders = Tables(spark, sf_dir)["orders"].select(
        "o_orderkey", "o_totalprice", F.year("o_orderdate").alias("o_year")
    )
    orders.write.partitionBy("o_year").parquet(path)
    fresh = orders.filter(F.col("o_orderkey") % 2 == 0).withColumn("o_totalprice", F.col("o_totalprice") * 2)
    return tb.incremental_refresh(path, fresh, "o_year", *REFRESH)


def mixed_orders(t: Tables) -> DataFrame:
    """Orders as text columns, some values missing."""
    return t["orders"].select(
        F.col("o_orderkey").cast("string").alias("order_key"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).cast("string").alias("customer"),
        F.when(F.col("o_orderkey") > 1, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("ordered"),
        F.col("o_totalprice").cast("decimal(12,2)").cast("string").alias("price"),
        F.lit(None).cast("string").alias("shipped"),
        F.col("o_orderpriority").alias("priority"),
    )


def tb_typed_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tb.typed_select(Tables(spark, sf_dir)["orders"], "Number")


def tb_infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    numbered = mixed_orders(t).withColumn("row_number", F.col("order_key").cast("long"))
    return tb.infer_types(numbered, "row_number")


def tb_declared_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = {"order_key": "Int64", "customer": "Int64", "ordered": "DateTime", "price": "Double", "shipped": "DateTime", "priority": "String"}
    typed = tb.apply_declared_types(mixed_orders(Tables(spark, sf_dir)), declared)
    return typed.withColumn("ordered", F.date_format("ordered", "yyyy-MM-dd"))


def tb_clean_column_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = Tables(spark, sf_dir)["orders"].select("o_orderkey", "o_custkey", "o_orderpriority")
    prefixed = orders.toDF(*[f"orders[{name}]" for name in orders.columns])
    return tb.clean_column_names(prefixed)


def th_file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.file_inventory(spark, sf_dir)


def th_file_size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.file_size_stats(health.file_inventory(spark, sf_dir))


def counted_files(t: Tables) -> DataFrame:
    counted = [health.count_file_rows(t[name], name) for name in TABLE_NAMES]
    result = counted[0]
    for part in counted[1:]:
        result = result.unionByName(part)
    return result


def th_rows_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.rows_per_file(counted_files(Tables(spark, sf_dir)))


def th_operation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = health.operation_metrics(operation_log(Tables(spark, sf_dir)), as_of())
    return metrics.select(
        *[c for c in metrics.columns if not c.startswith("last_")], shown("last_write"), shown("last_optimize"), shown("last_vacuum")
    )


def th_table_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report on the data directory; users of events stand for its tables' histories."""
    t = Tables(spark, sf_dir)
    names = F.array(*[F.lit(n) for n in TABLE_NAMES])
    user = (F.regexp_extract("table", r"(\d+)", 1).cast("int") % len(TABLE_NAMES)) + 1
    log = operation_log(t).withColumn("table", F.element_at(names, user))
    linked = t["region"].select(F.lower("r_name").alias("table_name"))
    return health.table_report(health.file_inventory(spark, sf_dir), counted_files(t), log, linked, as_of())


def th_maintenance_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = operation_log(Tables(spark, sf_dir)).filter(
        ~((F.col("table") == "table_7") & (F.col("operation") == "OPTIMIZE")) & (F.col("timestamp") < F.lit("2024-01-18").cast("timestamp_ntz"))
    )
    plan = health.maintenance_plan(log, as_of())
    return plan.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("optimize_last_run", "vacuum_last_run")})


def th_unreferenced_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the first of two snapshots, once the second is current."""
    root = scratch_path(spark, "snapshots")
    everyone = people(Tables(spark, sf_dir))
    tb.write_snapshot(everyone, root, 0, "WRITE")
    current = tb.write_snapshot(tb.delete_where(everyone, F.col("balance") < 0), root, 1, "DELETE")
    inventory = tb.file_listing(spark, f"{root}/v[0-9]*")
    listed = current.select(F.col("_metadata.file_path").alias("path")).distinct()
    plain = F.regexp_replace("path", "^file:/+", "/")
    now = F.current_timestamp() + F.expr("INTERVAL 1 HOUR")
    return health.unreferenced_files(inventory.withColumn("path", plain), listed.withColumn("path", plain), now)


def th_column_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-level fields of the paired customer documents, fourteen tables."""
    pairs = document_pairs(Tables(spark, sf_dir))
    table = F.concat(F.lit("t"), (F.col("doc_id") % 14).cast("string")).alias("table")

    def columns(side: str) -> DataFrame:
        return pairs.select(table, F.explode(F.json_object_keys(side)).alias("column"))

    drift = health.column_drift(columns("actual"), columns("predicted"))
    return drift.withColumns({c: F.array_join(c, ",") for c in ("left_only_columns", "right_only_columns")})


SUITE = {
    f.__name__: f
    for f in (
        tb_create, tb_append, tb_update, tb_delete, tb_merge, tb_compact, tb_schema_evolve, tb_history_counts,
        tb_history_times, tb_history_filter, tb_incremental_refresh, tb_typed_select, tb_infer_types, tb_declared_types,
        tb_clean_column_names, th_file_inventory, th_file_size_stats, th_rows_per_file, th_operation_metrics,
        th_table_report, th_maintenance_plan, th_unreferenced_files, th_column_drift,
    )
}

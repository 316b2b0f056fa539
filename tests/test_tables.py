"""Table operations, history and health on small worked tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallybook.operators import health
from tallybook.operators import tables as tb

SCHEMA = "id long, berth string, depth double"
START = [(11, "north quay", 7.5), (12, "south quay", 9.0), (13, "coal pier", 4.25), (14, "slip", 2.0)]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_sequence_of_operations(spark, tmp_path):
    root = str(tmp_path / "berths")
    table = tb.write_snapshot(spark.createDataFrame(START, SCHEMA), root, 0, "WRITE", {"numFiles": "1"})
    extra = spark.createDataFrame([(21, "tank jetty", 14.0)], SCHEMA)
    table = tb.write_snapshot(tb.append(table, extra), root, 1, "WRITE", {"numFiles": "2"})
    table = tb.write_snapshot(tb.update_where(table, F.col("depth") < 3, {"depth": F.col("depth") + 0.5}), root, 2, "UPDATE")
    table = tb.write_snapshot(tb.delete_where(table, F.col("berth").startswith("coal")), root, 3, "DELETE")
    source = spark.createDataFrame([(12, "renamed", 9.5), (30, "ferry stage", 6.0)], SCHEMA)
    table = tb.write_snapshot(tb.merge_upsert(table, source, ["id"], ["depth"]), root, 4, "MERGE")
    assert rows(table) == [(11, "north quay", 7.5), (12, "south quay", 9.5), (14, "slip", 2.5), (21, "tank jetty", 14.0), (30, "ferry stage", 6.0)]
    log = tb.history(spark, root)
    assert rows(tb.history_counts(log)) == [("DELETE", 1), ("MERGE", 1), ("UPDATE", 1), ("WRITE", 2)]
    assert [r.operation for r in tb.history_times(log).collect()][0] == "MERGE"
    assert sorted(r.operationMetrics["numFiles"] for r in tb.history_filter(log, "WRITE").collect()) == ["1", "2"]


def test_merge_is_delete_plus_insert_and_rejects_twins(spark):
    target = spark.range(100).select("id", (F.col("id") * 2).alias("v"))
    source = spark.range(50, 150).select("id", (F.col("id") * 3).alias("v"))
    merged = tb.merge_upsert(target, source, ["id"], ["v"])
    expected = target.join(source, "id", "left_anti").unionByName(source)
    assert rows(merged) == rows(expected)
    with pytest.raises(Exception, match="share a key"):
        tb.merge_upsert(target, source.unionByName(source.limit(1)), ["id"], ["v"]).collect()


def test_unknown_condition_keeps_rows(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "id int, v int")
    assert rows(tb.delete_where(df, F.col("v") > 3)) == [(1, None)]
    updated = tb.update_where(df, F.col("v") > 3, {"v": F.lit(0)})
    assert sorted(updated.collect(), key=lambda r: r.id)[1].v == 0 and updated.filter("id = 1").first().v is None


def test_schema_evolution(spark, tmp_path):
    old, path = spark.createDataFrame(START, SCHEMA), str(tmp_path / "evolving")
    new = spark.createDataFrame([(31, "dry dock", 8.0, "closed")], f"{SCHEMA}, state string")
    assert tb.append_evolving(old, new).filter(F.col("state").isNull()).count() == 4
    old.write.parquet(path)
    new.write.mode("append").parquet(path)
    assert spark.read.option("mergeSchema", True).parquet(path).filter("state is null").count() == 4


def test_incremental_refresh_replaces_only_the_range(spark, tmp_path):
    path = str(tmp_path / "parts")
    spark.range(40).select("id", (F.col("id") % 4).cast("int").alias("p")).write.partitionBy("p").parquet(path)
    fresh = spark.createDataFrame([(100, 1), (200, 3)], "id long, p int")
    got = rows(tb.incremental_refresh(path, fresh, "p", 1, 3))
    assert [r for r in got if r[1] == 1] == [(100, 1)]
    assert [r for r in got if r[1] == 2] == []
    assert len([r for r in got if r[1] in (0, 3)]) == 20
    again = rows(tb.incremental_refresh(path, spark.createDataFrame([(300, 2), (301, 2)], "id long, p int"), "p", 1, 3))
    assert [r for r in again if r[1] in (1, 2)] == [(300, 2), (301, 2)] and len(again) == 22
    third = tb.incremental_refresh(path, spark.createDataFrame([], "id long, p int"), "p", 0, 4)
    assert third.count() == 0 and tb.read_refreshed(spark, path, third.schema).count() == 0


def test_types(spark):
    sample = spark.createDataFrame(
        [(900, "40.5", dt.date(2031, 5, 6), "buoy", "06/05/2031"), (901, None, dt.date(2031, 5, 7), "light", "07/05/2031"), (902, "12", None, "horn", None)],
        "MarkNo int, Range string, Set date, Kind string, Checked string",
    )
    kinds = {r.column_name: r.column_type for r in tb.infer_types(sample, "MarkNo").collect()}
    assert kinds == {"MarkNo": "Number", "Range": "Number", "Set": "Date", "Kind": "Text", "Checked": "Date"}
    assert tb.typed_select(sample, "Number").columns == ["MarkNo"]
    assert tb.typed_select(sample, "All").columns == sample.columns


def test_declared_types(spark):
    raw = spark.createDataFrame([("1", "1", None, "a"), ("2", None, None, "b")], "k string, n string, d string, s string")
    typed = tb.apply_declared_types(raw, {"k": "Int64", "n": "Int64", "d": "DateTime", "s": "String"})
    assert dict(typed.dtypes) == {"k": "bigint", "n": "double", "d": "string", "s": "string"}


def test_clean_column_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`sales[amount]` int, `[total]` int, plain int")
    assert tb.clean_column_names(df).columns == ["amount", "total", "plain"]


def test_file_sizes(spark):
    mb = 1024 * 1024
    files = spark.createDataFrame([("t", f"f{i}", size * mb) for i, size in enumerate((1, 7, 8, 100))], "table string, path string, length long")
    stats = health.file_size_stats(files).first()
    assert (stats.num_files, stats.size_mb, stats.median_file_size_mb, stats.small_files_percentage) == (4, 116, 7, 50.0)


def test_inventory_levels(spark, tmp_path):
    one = spark.range(3)
    for place in ("plain", "flat.parquet", "schema_a/inner", "split/p=1"):
        one.coalesce(1).write.parquet(str(tmp_path / "root.1+x" / place))
    names = [r.table for r in health.file_inventory(spark, f"file://{tmp_path}/root.1+x/").collect()]
    assert sorted(names) == ["flat", "plain", "schema_a/inner", "split"]


def moment(text):
    return dt.datetime.fromisoformat(text)


def test_maintenance_plan(spark):
    now = "2024-03-01 00:00:00"
    log = spark.createDataFrame(
        [
            ("never", "WRITE", moment("2024-02-29 00:00:00")),
            ("edge", "OPTIMIZE", moment("2024-02-23 00:00:00")), ("edge", "VACUUM END", moment("2024-01-30 00:00:00")),
            ("recent", "OPTIMIZE", moment("2024-02-28 00:00:00")), ("recent", "VACUUM START", moment("2024-02-28 00:00:00")),
            ("recent", "OPTIMIZE", moment("2024-01-01 00:00:00")),
        ],
        "table string, operation string, timestamp timestamp_ntz",
    )
    plan = {r.table: (r.optimize_due, r.vacuum_due) for r in health.maintenance_plan(log, F.lit(now).cast("timestamp_ntz")).collect()}
    assert plan == {"never": (True, True), "edge": (False, True), "recent": (False, False)}


def test_table_report(spark):
    mb = 1024 * 1024
    files = spark.createDataFrame([("s/big", "a", 20 * mb), ("small", "b", 100)], "table string, path string, length long")
    counted = spark.createDataFrame([("s/big", "a", 10), ("small", "b", 3)], "table string, path string, num_rows long")
    log = spark.createDataFrame(
        [("small", "WRITE", moment("2024-01-01 00:00:00"), {"numFiles": "2"}), ("small", "WRITE", moment("2024-01-02 12:00:00"), {"numFiles": "9"})],
        "table string, operation string, timestamp timestamp_ntz, operationMetrics map<string,string>",
    )
    linked = spark.createDataFrame([("small",)], "table_name string")
    report = health.table_report(files, counted, log, linked, F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")).collect()
    assert [(r.schema_name, r.table_name, r.size_mb, r.is_shortcut) for r in report] == [("s", "big", 20, False), ("", "small", 1, True)]
    assert (report[1].write_operations, report[1].days_since_write, report[1].small_writes_percentage) == (2, 2, 50.0)


def test_column_drift(spark):
    left = spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "x")], "table string, column string")
    right = spark.createDataFrame([("t", "a"), ("t", "c"), ("u", "x")], "table string, column string")
    drift = health.column_drift(left, right)
    got = {r.table: (r.left_only_columns, r.right_only_columns, r.is_match) for r in drift.collect()}
    assert got == {"t": (["b"], ["c"], False), "u": ([], [], True)}
    assert tuple(health.drift_summary(drift).first()) == (2, 1)

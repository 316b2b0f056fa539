"""Job-log analytics over log lines made from the events table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.operators import logs as lg
from tallybook.session import scratch_path
from tallybook.sources.tables import Tables


def joined(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def event_lines(t: Tables) -> DataFrame:
    """One log line per event; users are log files, some lines are broken or untyped."""
    key, kind = F.col("event_id"), F.col("event_type")
    ms = F.expr("unix_millis(CAST(ts AS TIMESTAMP))").cast("string")
    number, user = key.cast("string"), F.col("user_id").cast("string")
    start = joined('{"Event": "SparkListenerApplicationStart", "App Name": "app ', user, '", "App ID": "a-', user, '", "Timestamp": ', ms, "}")
    end = joined('{"Event": "SparkListenerApplicationEnd", "Timestamp": ', ms, "}")
    job = joined(
        '{"Event": "SparkListenerJobEnd", "Job ID": ', number, ', "Completion Time": ', ms,
        F.when(key % 4 == 0, ', "Job Result": {"Result": "JobFailed"}}').when(key % 4 == 1, "}").otherwise(', "Job Result": {"Result": "JobSucceeded"}}'),
    )
    stage = joined(
        '{"Event": "SparkListenerStageCompleted", "Timestamp": ', ms, ', "Stage Info": {"Stage ID": ', number, ', "Stage Name": "scan ', user,
        '", "Number of Tasks": ', (key % 9 + 1).cast("string"), ', "Number of Complete Tasks": ', (key % 9).cast("string"),
        F.when(key % 2 == 0, ', "Number of Failed Tasks": 1}}').otherwise("}}"),
    )
    executor = joined('{"Event": "SparkListenerExecutorAdded", "Executor ID": "', number, '", "Timestamp": ', ms, F.when(key % 3 == 0, ', "Resources": {"cores":4}}').otherwise("}"))
    settings = joined(
        '{"Event": "SparkListenerEnvironmentUpdate", "Timestamp": ', ms, ', "Spark Properties": {"spark.app.name": "app ', user,
        '", "spark.executor.memory": "', (key % 8 + 1).cast("string"), 'g", "spark.executor.memoryOverhead": "1g", "spark.ui.port": "0"}, "JVM Information": {"Java Version": "',
        (key % 3 + 15).cast("string"), '", "Scala Version": "2.13"}}',
    )
    line = (
        F.when(kind == "view", F.when(key % 2 == 0, job).otherwise(stage))
        .when(kind == "click", executor)
        .when(kind == "signup", start)
        .when(kind == "purchase", F.when(key % 2 == 0, end).otherwise(settings))
        .when(key % 2 == 0, joined('{"Timestamp": ', ms, ', "message": "task failed with code ', number, '"}'))
        .otherwise(joined("broken line ", number, " {"))
    )
    return t["events"].select(F.col("user_id").alias("log"), line.alias("line"))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lg.parse_log(event_lines(Tables(spark, sf_dir)))


def lg_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines written as gzip text and read back as a log."""
    path = scratch_path(spark, "log")
    event_lines(Tables(spark, sf_dir)).select("line").write.option("compression", "gzip").text(path)
    return lg.parse_log(lg.read_lines(spark, path)).select("event", "at", "line")


def lg_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lg.event_counts(parsed(spark, sf_dir), ["log"])


def lg_application(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lg.application(parsed(spark, sf_dir), ["log"])


def lg_config_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lg.config_props(parsed(spark, sf_dir), ["log"])


def lg_jvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lg.jvm_information(parsed(spark, sf_dir), ["log"])


def lg_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lg.jobs(parsed(spark, sf_dir), by=["log"])


def lg_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lg.stages(parsed(spark, sf_dir), by=["log"])


def lg_executors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lg.executors(parsed(spark, sf_dir), by=["log"])


def lg_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lg.exceptions(parsed(spark, sf_dir), by=["log"])


SUITE = {
    f.__name__: f
    for f in (lg_read, lg_event_counts, lg_application, lg_config_props, lg_jvm, lg_jobs, lg_stages, lg_executors, lg_exceptions)
}

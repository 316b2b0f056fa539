"""Job event logs: one JSON event per line, read and summarised."""

from __future__ import annotations

import gzip
import io
import zipfile
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallybook.functions.numeric import col
from tallybook.sources.packed_log import can_read, read_packed_log

# Event names, watched properties, error words, file signatures.
APP_START, APP_END = "SparkListenerApplicationStart", "SparkListenerApplicationEnd"
ENVIRONMENT, JOB_END = "SparkListenerEnvironmentUpdate", "SparkListenerJobEnd"
STAGE_DONE, EXECUTOR_ADDED = "SparkListenerStageCompleted", "SparkListenerExecutorAdded"
KEY_PROPERTIES = (
    "spark.app.name", "spark.driver.memory", "spark.executor.memory", "spark.executor.cores",
    "spark.executor.instances", "spark.serializer", "spark.sql.shuffle.partitions",
)
ERROR_WORDS = "Error|error|exception|Exception|Failed|failed"
SIGNATURES = {"504B0304": "zip", "1F8B": "gzip"}
UNKNOWN = "Unknown"
JVM_FIELDS = (("Java Version", "java_version"), ("Java Home", "java_home"), ("Scala Version", "scala_version"))
FIRST_EVENTS, FIRST_EXCEPTIONS = 10, 20
BATCH_LINES = 10_000


def file_format(content: Column) -> Column:
    """Format of a log file by its first bytes."""
    head = F.hex(F.substring(content, 1, 4))
    found = F.lit("plain")
    for signature, name in SIGNATURES.items():
        found = F.when(head.startswith(signature), name).otherwise(found)
    return found


def unpack_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines of gzip files and of every member of zip archives, told by their first bytes, in bounded batches."""

    def lines_of(stream) -> Iterator[pd.DataFrame]:
        text = io.TextIOWrapper(stream, encoding="utf-8", errors="replace", newline="\n")
        while lines := [line.rstrip("\r\n") for line in islice(text, BATCH_LINES)]:
            yield pd.DataFrame({"line": lines})

    for batch in batches:
        for content in batch["content"]:
            if content[:2] == bytes.fromhex("1F8B"):
                with gzip.GzipFile(fileobj=io.BytesIO(content)) as stream:
                    yield from lines_of(stream)
                continue
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                for member in archive.namelist():
                    with archive.open(member) as stream:
                        yield from lines_of(stream)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Log lines of plain, gzip and zip files, told apart by their first bytes.

    Where the store can be opened by the packed-log source, archive members are read side by
    side as streams; ``read_packed_log`` also says what could not be read. Elsewhere Spark
    hands over packed files whole, which limits them to 2 GB.
    """
    if can_read(path):
        return read_packed_log(spark, path).filter(F.col("line").isNotNull()).select("line")
    return read_whole_files(spark, path)


def read_whole_files(spark: SparkSession, path: str) -> DataFrame:
    """The same through Spark's own readers.

    Gzip files with their usual extension are unpacked by Spark. No line of a plain
    log begins with a signature, so one pass over first bytes finds the packed files;
    their paths are listed as Spark lists the files of a folder.
    """
    lines = spark.read.option("pathGlobFilter", "[!.]*").text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"))
    packed = [r["path"] for r in lines.filter(file_format(F.col("line").cast("binary")) != "plain").select("path").distinct().collect()]
    if not packed:
        return lines.select("line")
    archives = spark.read.format("binaryFile").load(packed).select("content").mapInPandas(unpack_lines, "line string")
    return lines.filter(~F.col("path").isin(packed)).select("line").unionByName(archives)


def parse_log(lines: DataFrame, line: str = "line") -> DataFrame:
    """Events with their type and time; lines that are not JSON are skipped."""
    parsed = lines.withColumn("body", F.try_parse_json(line)).filter(F.col("body").isNotNull())
    stamp = F.coalesce(value("$.Timestamp", "long"), value("$['Completion Time']", "long"))
    return parsed.withColumn("event", F.coalesce(value("$.Event", "string"), F.lit(UNKNOWN))).withColumn("at", stamp)


def value(path: str, kind: str, body: str = "body") -> Column:
    return F.try_variant_get(body, path, kind)


def event_counts(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Events per type, and of all types, per group of lines."""
    by = by or []
    counts = log.groupBy(*by, "event").agg(F.count(F.lit(1)).alias("events"))
    totals = counts.groupBy(*by).agg(F.sum("events").alias("total_events"))
    return counts.join(totals, by) if by else counts.crossJoin(totals)


def first_of(rows: DataFrame, order: list[str], limit: int | None, by: list[str] | None) -> DataFrame:
    """First rows in order, of each group if there are any; no limit keeps all."""
    if limit is None:
        return rows
    if not by:
        return rows.orderBy(*order).limit(limit)
    place = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_place", place).filter(F.col("_place") <= limit).drop("_place")


def jvm_information(log: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Java version and home of environment events."""
    found = log.filter(F.col("event") == ENVIRONMENT)
    parts = [value(f"$['JVM Information']['{name}']", "string").alias(column) for name, column in JVM_FIELDS]
    return found.select(*(keep or []), "at", *parts)


def clock(millis: Column) -> Column:
    return F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd HH:mm:ss")


def duration_text(millis: Column) -> Column:
    """Whole minutes and seconds with one digit: 83500 -> 1m 23.5s."""
    tenths = F.floor((millis + 50) / 100)
    minutes = F.floor(millis / 60000)
    rest = tenths - minutes * 600
    return F.concat(
        minutes.cast("string"), F.lit("m "), F.floor(rest / 10).cast("string"), F.lit("."), (rest % 10).cast("string"), F.lit("s")
    )


def application(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Name, id, times and duration of the application, per group of lines."""
    kind = F.col("event")
    start = F.struct(
        F.coalesce(value("$['App Name']", "string"), F.lit(UNKNOWN)).alias("name"),
        F.coalesce(value("$['App ID']", "string"), F.lit(UNKNOWN)).alias("id"),
        F.coalesce("at", F.lit(0)).alias("start_time"),
    )
    found = log.filter(kind.isin(APP_START, APP_END)).groupBy(*(by or [])).agg(
        F.max_by(F.when(kind == APP_START, start), F.when(kind == APP_START, F.coalesce("at", F.lit(0)))).alias("s"),
        F.max(F.when(kind == APP_END, F.coalesce("at", F.lit(0)))).alias("end_time"),
    )
    begin, end = F.col("s.start_time"), F.col("end_time")
    both = (begin != 0) & (end != 0)
    return found.select(
        *(by or []),
        F.col("s.name").alias("name"),
        F.col("s.id").alias("id"),
        begin.alias("start_time"),
        F.when(begin != 0, clock(begin)).when(begin.isNotNull(), UNKNOWN).alias("start_time_formatted"),
        "end_time",
        F.when(both, clock(end)).alias("end_time_formatted"),
        F.when(both, (end - begin) / 1000).alias("duration_sec"),
        F.when(both, duration_text(end - begin)).alias("duration_formatted"),
    )


def config_props(log: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Watched Spark properties of environment events, one row each."""
    props = value("$['Spark Properties']", "map<string,string>")

    def watched(key: Column, _: Column) -> Column:
        test = F.lit(False)
        for name in KEY_PROPERTIES:
            test = test | F.contains(key, F.lit(name))
        return test

    kept = log.filter(F.col("event") == ENVIRONMENT).select(*(keep or []), F.map_filter(props, watched).alias("props"))
    return kept.select(*(keep or []), F.explode("props").alias("property", "setting"))


def jobs(log: DataFrame, limit: int | None = FIRST_EVENTS, by: list[str] | None = None) -> DataFrame:
    """First finished jobs of each log."""
    rows = log.filter(F.col("event") == JOB_END).select(
        *(by or []),
        value("$['Job ID']", "long").alias("id"),
        F.coalesce(value("$['Job Result'].Result", "string"), F.lit(UNKNOWN)).alias("result"),
        value("$['Completion Time']", "long").alias("completion_time"),
    )
    return first_of(rows, ["completion_time", "id"], limit, by)


def stages(log: DataFrame, limit: int | None = FIRST_EVENTS, by: list[str] | None = None) -> DataFrame:
    """First completed stages of each log."""
    rows = log.filter(F.col("event") == STAGE_DONE).select(
        *(by or []),
        "at",
        value("$['Stage Info']['Stage ID']", "long").alias("id"),
        value("$['Stage Info']['Stage Name']", "string").alias("name"),
        value("$['Stage Info']['Number of Tasks']", "long").alias("tasks"),
        value("$['Stage Info']['Number of Complete Tasks']", "long").alias("successful_tasks"),
        F.coalesce(value("$['Stage Info']['Number of Failed Tasks']", "long"), F.lit(0)).alias("failed_tasks"),
    )
    return first_of(rows, ["at", "id"], limit, by).drop("at")


def executors(log: DataFrame, limit: int | None = FIRST_EVENTS, by: list[str] | None = None) -> DataFrame:
    """First added executors of each log; missing resources read as an empty object."""
    resources = F.coalesce(F.to_json(F.try_variant_get("body", "$.Resources", "variant")), F.lit("{}"))
    rows = log.filter(F.col("event") == EXECUTOR_ADDED).select(
        *(by or []), value("$['Executor ID']", "string").alias("id"), F.col("at").alias("added_time"), resources.alias("resources")
    )
    return first_of(rows, ["added_time", "id"], limit, by)


def exceptions(log: DataFrame, limit: int | None = FIRST_EXCEPTIONS, strict: bool = False, line: str = "line", by: list[str] | None = None) -> DataFrame:
    """First events of each log that mention an error anywhere; ``strict`` looks at text values only.

    The plain rule also matches key names, for example a ``Failed`` flag.
    """
    text = col(line)
    if strict:
        text = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"\s*:', "")
    found = log.filter(text.rlike(ERROR_WORDS)).select(*(by or []), "event", "at", line)
    return first_of(found, ["at", line], limit, by)

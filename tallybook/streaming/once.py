"""Ingestion whose tables hold every row of the source once, whenever it is stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallybook.streaming.transactions import MAX_FILES_PER_TRIGGER, SCHEMA, decode_events

QUERY_ID = "sql.streaming.queryId"
CORRUPT = "_corrupt"


def judged(events: DataFrame, schema: str = SCHEMA, body: str = "body") -> DataFrame:
    """``data``, the typed body, and ``reason``, why it was rejected: not JSON of the schema, or not there at all."""
    parsed = F.from_json(body, f"{schema}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT})
    rows = events.withColumn("data", parsed)
    reason = F.when(F.col(body).isNull(), "no body").when(F.col("data").isNull() | F.col(f"data.{CORRUPT}").isNotNull(), "malformed body")
    return rows.withColumn("reason", reason)


def batch_folder(root: str, query_id: str, batch_id: int) -> str:
    return f"{root}/query_id={query_id}/batch_id={batch_id}"


def ingest_once(
    spark: SparkSession,
    source: str,
    accepted: str,
    rejected: str,
    checkpoint: str,
    max_files: int = MAX_FILES_PER_TRIGGER,
    interval: str | None = None,
    after_write: Callable[[int], None] | None = None,
) -> StreamingQuery:
    """Parsed events of a folder of ``body binary`` files to one table, malformed bodies to another.

    The checkpoint deals the same rows to a batch whenever it is run, and a batch replaces its
    own folder of either table, so one that was written but not committed when the query stopped
    is written again in place. Folders carry the query's id too: a query with a new
    checkpoint counts its batches from zero and must not meet those of an older one.
    Rejected bodies keep the file and the row in which they stand. ``after_write`` is called
    between the writes of a batch and its commit.
    """
    events = spark.readStream.schema("body binary").option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", True).parquet(source)
    placed = events.select("body", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.row_index").alias("source_row"))

    def write(batch: DataFrame, batch_id: int) -> None:
        query_id = batch.sparkSession.sparkContext.getLocalProperty(QUERY_ID)
        rows = judged(decode_events(batch)).persist()
        try:
            good, bad = F.col("reason").isNull(), F.col("reason").isNotNull()
            replace(rows.where(bad).select("body", "reason", "source_file", "source_row"), rejected, query_id, batch_id)
            replace(rows.where(good).select("data.*").drop(CORRUPT), accepted, query_id, batch_id)
        finally:
            rows.unpersist()
        if after_write:
            after_write(batch_id)

    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return placed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def replace(rows: DataFrame, root: str, query_id: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(batch_folder(root, query_id, batch_id))

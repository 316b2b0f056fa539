"""Stream steps over transactions made from the events table, as batch twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions.numeric import money
from tallybook.session import scratch_path
from tallybook.sources.tables import Tables
from tallybook.streaming import once
from tallybook.streaming import transactions as tx

SOURCE_FILES = 16


def joined(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def bodies(t: Tables) -> DataFrame:
    """Event bodies: plain, padded and unpadded base64, with equals sign, broken."""
    key, user = F.col("event_id"), F.col("user_id").cast("string")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")

    def text(mark: str) -> Column:
        return joined(
            '{"Step": ', (key % 4 + 1).cast("string"), ', "Type": "', F.upper("event_type"), mark, '", "Amount": ', money("value").cast("string"),
            ', "NameOrig": "C', user, '", "OldBalanceOrig": 10.5, "NewBalanceOrig": ', (key % 1000).cast("string"), '.25, "NameDest": "M', user,
            '", "OldBalanceDest": 0.0, "NewBalanceDest": 1.0, "IsFraud": ', (key % 2).cast("string"), ', "IsFlaggedFraud": 0, "Rec": 1, "DateTimeNow": "', stamp, '"}',
        )

    plain = text("")
    encoded = F.regexp_replace(F.base64(plain.cast("binary")), r"[\r\n]", "")
    body = (
        F.when(key % 5 == 0, plain)
        .when(key % 5 == 1, encoded)
        .when(key % 5 == 2, F.regexp_replace(encoded, "=+$", ""))
        .when(key % 5 == 3, text("=x"))
        .otherwise(joined("broken ", key.cast("string"), " {"))
    )
    return t["events"].select("event_id", body.cast("binary").alias("body"))


def shown(df: DataFrame) -> DataFrame:
    return df.withColumn("DateTimeNow", F.date_format("DateTimeNow", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def st_decode_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.decode_events(bodies(Tables(spark, sf_dir)))


def st_parse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = tx.decode_events(bodies(Tables(spark, sf_dir)))
    return shown(tx.parse_events(decoded, keep=("event_id",)))


def st_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies landed as files, drained by the stream in several batches."""
    landing, out, state = (scratch_path(spark, name) for name in ("landing", "ingested", "checkpoint"))
    bodies(Tables(spark, sf_dir)).select("body").repartition(SOURCE_FILES).write.parquet(landing)
    query = tx.ingest(spark, landing, out, state, max_files=SOURCE_FILES // 2)
    query.awaitTermination()
    return shown(spark.read.parquet(out))


def st_ingest_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same bodies in two tables, parsed and rejected, shown as one."""
    landing, good, bad, state = (scratch_path(spark, name) for name in ("landing", "accepted", "rejected", "checkpoint"))
    bodies(Tables(spark, sf_dir)).select("body").repartition(SOURCE_FILES).write.parquet(landing)
    once.ingest_once(spark, landing, good, bad, state, max_files=SOURCE_FILES // 2).awaitTermination()
    accepted = shown(spark.read.parquet(good)).drop("query_id", "batch_id")
    return accepted.unionByName(spark.read.parquet(bad).select("body", "reason"), allowMissingColumns=True)


def st_synthetic_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tx.synthetic_transactions(Tables(spark, sf_dir)["events"], "event_id", "ts")


SUITE = {f.__name__: f for f in (st_decode_events, st_parse_events, st_ingest, st_ingest_once, st_synthetic_transactions)}

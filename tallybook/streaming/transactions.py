"""Transaction events: generation, decoding, parsing and checkpointed ingestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# Event layout, transaction kinds and value ranges.
SCHEMA = (
    "Step int, Type string, Amount double, NameOrig string, OldBalanceOrig double, NewBalanceOrig double, "
    "NameDest string, OldBalanceDest double, NewBalanceDest double, IsFraud int, IsFlaggedFraud int, Rec int, "
    "DateTimeNow timestamp"
)
TYPES = ("PAYMENT", "TRANSFER", "CASH_OUT", "DEBIT", "CREDIT")
MAX_FILES_PER_TRIGGER = 500


def decode_events(df: DataFrame, body: str = "body") -> DataFrame:
    """Event body as text; bodies with an equals sign are tried as base64 first.

    JSON that merely contains the sign is not base64 and stays as it is.
    """
    text = F.col(body).cast("string")
    decoded = F.try_to_binary(text, F.lit("base64")).cast("string")
    return df.withColumn(body, F.when(text.like("%=%"), F.coalesce(decoded, text)).otherwise(text))


def parse_events(df: DataFrame, schema: str = SCHEMA, body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed columns of the JSON body; malformed text gives NULLs."""
    return df.select(*keep, F.from_json(body, schema).alias("data")).select(*keep, "data.*")


def ingest(
    spark: SparkSession,
    source: str,
    out: str,
    checkpoint: str,
    max_files: int = MAX_FILES_PER_TRIGGER,
    files_per_batch: int | None = None,
    interval: str | None = None,
) -> StreamingQuery:
    """Append parsed events from a folder of ``body binary`` files to Parquet.

    The checkpoint makes a restart continue where it stopped. ``files_per_batch``
    bounds the output files of a batch; with an ``interval`` the query keeps
    running, otherwise it ends when the source is drained.
    """
    events = (
        spark.readStream.schema("body binary").option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", True).parquet(source)
    )
    parsed = parse_events(decode_events(events))
    if files_per_batch:
        parsed = parsed.coalesce(files_per_batch)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return (
        parsed.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start(out)
    )


def uniform(key: Column, draw: int, seed: int) -> Column:
    """Number in [0, 1) fixed by key, draw and seed, whatever the partitioning."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(draw), F.lit(seed)), 11)
    return bits.cast("double") / float(1 << 53)


def whole(u: Column, low: int, high: int) -> Column:
    """Integer in [low, high)."""
    return F.floor(u * (high - low)).cast("long") + low


def synthetic_transactions(keys: DataFrame, key: str, at: str, seed: int = 42) -> DataFrame:
    """One random transaction per key, within the stated ranges."""

    def u(draw: int) -> Column:
        return uniform(F.col(key), draw, seed)

    kinds = F.array(*[F.lit(name) for name in TYPES])
    return keys.select(
        key,
        whole(u(1), 1, 5).cast("int").alias("Step"),
        F.get(kinds, whole(u(2), 0, len(TYPES)).cast("int")).alias("Type"),
        F.round(u(3) * (50000 - 50) + 50, 2).alias("Amount"),
        F.concat(F.lit("C"), whole(u(4), 100000, 2000000000).cast("string")).alias("NameOrig"),
        F.round(F.pow(F.lit(10.0), u(5) * 6), 2).alias("OldBalanceOrig"),
        F.round(whole(u(6), 2, 10000) * F.exp(u(7) * 2.3), 2).alias("NewBalanceOrig"),
        F.concat(F.lit("M"), whole(u(8), 10000000, 20000000).cast("string")).alias("NameDest"),
        F.round(u(9) * u(10) * 1000000, 2).alias("OldBalanceDest"),
        F.round(500000 + whole(u(11), -1000, 1000000) + u(12) * 500000, 2).alias("NewBalanceDest"),
        F.when(whole(u(13), 0, 20) == 0, 1).otherwise(0).alias("IsFraud"),
        F.when(whole(u(14), 0, 30) == 0, 1).otherwise(0).alias("IsFlaggedFraud"),
        F.lit(1).alias("Rec"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("DateTimeNow"),
    )

"""What the text operators share: Arrow helpers, scratch tables, hashes, components.

Null texts read as empty. Operators take a frame and the names of its columns and
select only those, so further columns, also of clashing names, do no harm. Rows of
equal ids are separate rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.session import scratch_path
from tallybook.sources.tables import Tables

MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SLICE_ROWS = 500
CHUNK = 1 << 18
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Lower case for A-Z; digits, letters and all bytes beyond ASCII stay, the others separate words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return Tables(spark, sf_dir)[name]


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """(doc_id, text as UTF-8 bytes); null texts are empty. With ``key_col`` also key."""
    body = F.coalesce(F.col(f"`{text_col}`").cast("string").cast("binary"), F.lit(b"").cast("binary"))
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), body.alias("text"), *([] if key_col is None else [F.col(f"`{key_col}`").alias("key")]))


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Arrow batches through ``work``, in slices that keep long texts within memory."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                yield from work(batch.slice(start, SLICE_ROWS))

    return df.mapInArrow(run, schema)


class Scratch:
    """Tables written while a step runs, removed at its end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def result(self, df: DataFrame, label: str) -> DataFrame:
        """The step's own result as a table, which stays; in a step within a step it belongs to the outer one."""
        SCOPES.remove(self)
        try:
            return written(df, label)
        finally:
            SCOPES.append(self)


#: Steps that are running, the innermost last.
SCOPES: list[Scratch] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """A step whose written tables are removed when it ends; what it returns must be its ``result``."""
    scope = Scratch(spark)
    SCOPES.append(scope)
    try:
        yield scope
    finally:
        SCOPES.remove(scope)
        for path in scope.paths:
            removed(spark, path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a scratch table, in whatever store it lies."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def write_table(df: DataFrame, path: str) -> DataFrame:
    """The frame as a table; the files of its shuffles go when it is written, since no one reads them again."""
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, "false")
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(SHUFFLE_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame as a table below the shared folder: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    if SCOPES:
        SCOPES[-1].paths.append(path)
    return write_table(df, path)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (a fixed finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def fold_words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; a shorter text is one run."""
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    out = np.full(len(hashes) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        out = mix(out + hashes[k : len(hashes) - size + 1 + k])
    return out


def salted_join(left: DataFrame, right: DataFrame, key: str, salt: int = 8, how: str = "left") -> DataFrame:
    """Join with one right row per key; a key that many left rows share is dealt to ``salt`` tasks."""
    left = left.withColumn("_salt", (F.rand(11) * salt).cast("int"))
    right = right.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salt)])))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def map_bits(wanted: DataFrame) -> int:
    """log2 of the bits of a map for so many keys: 16 a key, between 2**20 and 2**28 (32 MB)."""
    return min(28, max(20, (16 * wanted.count()).bit_length()))


def flagged(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``df`` with ``_maybe``: whether its key may be among the wanted ones, before a join that would shuffle all rows.

    The wanted keys (a written table) are hashed into a bit map, sized by their number up to
    32 MB, that every task reads. Rows may be flagged that are not wanted, the more the further the
    keys outgrow the map; no wanted one is missed.
    """
    bit = F.pmod(F.xxhash64(key), F.lit(1 << map_bits(wanted)))
    marks = wanted.select(bit.alias("_bit")).groupBy(F.bitmap_bucket_number("_bit").alias("_bucket"))
    marks = marks.agg(F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_map"))
    place = F.bitmap_bit_position("_bit")
    byte = F.conv(F.hex(F.substring("_map", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = df.withColumn("_bit", bit).withColumn("_bucket", F.bitmap_bucket_number("_bit")).join(F.broadcast(marks), "_bucket", "left")
    return found.withColumn("_maybe", F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))).select(*df.columns, "_maybe")


def likely(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key may be among the wanted ones; see ``flagged``."""
    return flagged(df, key, wanted).where("_maybe").select(*df.columns)


def excluding(df: DataFrame, key: str, unwanted: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key is not among the unwanted ones (a written table); only rows that may be are shuffled."""
    rows = flagged(df, key, unwanted)
    keys = unwanted.select(F.col(key).alias("_unwanted")).distinct()
    doubtful = rows.where("_maybe").join(keys, F.col(key) == F.col("_unwanted"), "left_anti")
    return rows.where(~F.col("_maybe")).unionByName(doubtful).select(*df.columns)


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the least node each is connected with, but for those least ones."""
    nodes, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    root, a, b = np.arange(len(nodes)), ends[: len(u)], ends[len(u) :]
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    below = root != np.arange(len(nodes))
    return nodes[below], nodes[root[below]]


def star_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of the same components: what comes in, by ``CHUNK`` links, becomes stars around their least nodes."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def close():
        if held:
            u, v = stars(*(np.concatenate(ends) for ends in zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(u) for u, _ in held) >= CHUNK:
            yield from close()
            held = []
    yield from close()


def contracted(links: DataFrame) -> DataFrame:
    """The links of each task as stars; see ``star_batches``."""
    return links.select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(star_batches, "u long, v long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (u, v): one row (node, root), root the least node.

    Alternates large-star and small-star steps, after what stands in one task was connected there, until
    every node but the roots has one link, to a root. Each step is an aggregation to the
    least neighbour and a join on the node, which adaptive execution can split; each
    round is a written table, so an executor's loss repeats one round at most, and the
    table of the round before is removed once the next one stands. Null ends are dropped; loops and repeated edges do no harm.
    """
    pairs = edges.where("u is not null and v is not null").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    pairs = written(pairs.distinct(), "edges")
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    links, standing = contracted(pairs.where("u <> v")), None
    spark = pairs.sparkSession
    for _ in range(most_rounds):
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        links = joined.select("u", F.col("m").alias("v")).union(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        path = scratch_path(spark, "links")
        links = write_table(contracted(links.distinct()), path)
        if standing:
            removed(spark, standing)
        standing = path
        ends = links.select(F.col("u").alias("node"), F.col("v").alias("above")).union(links.select("v", F.lit(None)))
        ends = ends.groupBy("node").agg(F.min("above").alias("a"), F.max("above").alias("b"), F.bool_or(F.col("above").isNull()).alias("root"))
        if ends.where("a <> b or a is not null and root").isEmpty():
            break  # no root lies below another, and no node below two
    else:
        raise RuntimeError(f"components unsettled after {most_rounds} rounds")
    if SCOPES:
        SCOPES[-1].paths.append(standing)
    roots = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("r"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("r", "node").alias("root"))

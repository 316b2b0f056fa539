"""Token-id files in patched frame-of-reference blocks.

A shard holds the ids of consecutive documents in blocks of ``BLOCK`` ids. A block
stores its minimum and the differences to it, packed at the width that holds
``percentile`` of them; the others are exceptions, with their place in the shard and
full difference in lists. An index of block starts lets one block be read alone.

A shard is one binary value, little-endian:

    magic "PFR1", number of documents, ids, blocks, exceptions (5 x 4 bytes)
    length of each document (4 bytes each)
    block minima (4 each), block widths (1 each), block starts in bytes (8 each, one more than blocks)
    exception places and differences (4 bytes each)
    packed blocks, most significant bit first

Shards are rows of a Parquet table (part, shard, doc_ids, n_tokens, payload), which any
store holds and Spark commits as a whole, so a lost executor leaves no half shard.
Documents are dealt by ranges of doc_id and sorted (null first, rows of one id by a hash of
their text, then the text), so ids stand in ascending doc_id order over parts and shards.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallybook.llm.common import SLICE_ROWS, texts

MAGIC = b"PFR1"
BLOCK = 256
SHARD_IDS = 1 << 20
MOST_PIECES = 1_400_000
WIDTHS = np.arange(33)
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
#: Letters of two bytes, of Western languages.
LETTER = re.compile(b"\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4\xc5][\x80-\xbf]")
#: First bytes of U+0300 to U+037F, marks that join the letter before them.
MARKS = b"\xcc", b"\xcd"


def bit_lengths(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


#: Bit lengths of all 16-bit values.
SHORT_LENGTHS = bit_lengths(np.arange(1 << 16))


def pack(lengths: np.ndarray, ids: np.ndarray, percentile: float = 0.95) -> bytes:
    """The shard of documents with these lengths, whose ids follow one another."""
    blocks = -(-len(ids) // BLOCK)
    padded = np.full(blocks * BLOCK, 0, dtype=np.uint32)
    padded[: len(ids)] = ids
    padded[len(ids) :] = ids[-1] if len(ids) else 0
    rows = padded.reshape(blocks, BLOCK)
    minima = rows.min(axis=1) if blocks else np.zeros(0, np.uint32)
    rows = rows - minima[:, None]
    bits = SHORT_LENGTHS[rows] if not blocks or rows.max() < 1 << 16 else bit_lengths(rows)
    widths = np.partition(bits, int(percentile * (BLOCK - 1)), axis=1)[:, int(percentile * (BLOCK - 1))] if blocks else np.zeros(0, np.uint8)
    wide = bits > widths[:, None]
    places = np.flatnonzero(wide).astype(np.uint32)
    excess = rows[wide].astype(np.uint32)
    rows[wide] = 0
    starts = np.zeros(blocks + 1, dtype=np.uint64)
    starts[1:] = np.cumsum(widths.astype(np.uint64) * (BLOCK // 8))
    body = np.zeros(int(starts[-1]), dtype=np.uint8)
    for width in np.unique(widths[widths > 0]):
        mine = np.flatnonzero(widths == width)
        size = 2 if width <= 16 else 4
        raw = np.unpackbits(rows[mine].astype(f">u{size}").view(np.uint8).ravel()).reshape(len(mine), BLOCK, 8 * size)
        packed = np.packbits(raw[:, :, 8 * size - width :].ravel()).reshape(len(mine), -1)
        body[(starts[mine][:, None] + np.arange(packed.shape[1], dtype=np.uint64)).ravel()] = packed.ravel()
    head = MAGIC + struct.pack("<4I", len(lengths), len(ids), blocks, len(places))
    parts = (lengths.astype("<u4"), minima.astype("<u4"), widths.astype(np.uint8), starts.astype("<u8"), places.astype("<u4"), excess.astype("<u4"), body)
    return head + b"".join(p.tobytes() for p in parts)


class Shard:
    """A packed shard: its index is read at once, blocks when asked for."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a token shard")
        docs, self.n_ids, blocks, exceptions = struct.unpack_from("<4I", payload, 4)
        at = 20

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, dtype=kind, count=count, offset=at)
            at += out.nbytes
            return out

        self.lengths, self.minima, self.widths = take("<u4", docs), take("<u4", blocks), take("u1", blocks)
        self.starts, self.places, self.excess = take("<u8", blocks + 1), take("<u4", exceptions), take("<u4", exceptions)
        self.body = np.frombuffer(payload, dtype=np.uint8, offset=at)

    def blocks(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids of blocks ``first`` up to ``last``."""
        last = len(self.widths) if last is None else last
        out = np.zeros((last - first, BLOCK), dtype=np.uint32)
        widths = self.widths[first:last]
        for width in np.unique(widths[widths > 0]):
            mine = np.flatnonzero(widths == width)
            size = int(width) * BLOCK // 8
            raw = self.body[(self.starts[first + mine][:, None] + np.arange(size, dtype=np.uint64)).ravel()].reshape(len(mine), size)
            whole = 2 if width <= 16 else 4
            bits = np.zeros((len(mine), BLOCK, 8 * whole), dtype=np.uint8)
            bits[:, :, 8 * whole - width :] = np.unpackbits(raw.ravel()).reshape(len(mine), BLOCK, width)
            out[mine] = np.packbits(bits.ravel()).reshape(len(mine), BLOCK * whole).view(f">u{whole}")
        low, high = np.searchsorted(self.places, [first * BLOCK, last * BLOCK])
        out.ravel()[self.places[low:high] - np.uint32(first * BLOCK)] = self.excess[low:high]
        out += self.minima[first:last, None]
        return out.ravel()[: max(0, self.n_ids - first * BLOCK)]

    def document(self, k: int) -> np.ndarray:
        """Ids of one document, from its blocks alone."""
        start = int(self.lengths[:k].sum())
        end = start + int(self.lengths[k])
        first = start // BLOCK
        return self.blocks(first, -(-end // BLOCK))[start - first * BLOCK : end - first * BLOCK]


class LibraryEncoder:
    """The tokenizers library, asked once per piece of text between ASCII white space.

    The vocabulary's rules drop white space and join nothing across it, so the ids of a
    text are those of its pieces. Pieces are remembered while there is room.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.pieces: dict[bytes, bytes] = {}

    def encode_all(self, bodies: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        # A-Z are lowered by the rules anyway, but after marks have joined them
        cut = [(b.lower() if b"<|" not in b and (b.isascii() or not any(m in b for m in MARKS)) else b).split() for b in bodies]
        known, local = self.pieces, dict.fromkeys(chain.from_iterable(cut))
        new = {p for p in local if p not in known}
        # punctuation after a letter or digit is a run of its own, so the rest may be known
        stems = {p: m for p in new if (m := p.rstrip(PUNCTUATION)) != p and (m[-1:].isalnum() or LETTER.fullmatch(m[-2:])) and b"<|" not in p}
        asked = [p for p in {*(new - stems.keys()), *stems.values(), *(p[len(m) :] for p, m in stems.items())} if p not in known]
        found = self.library.encode_batch_fast([p.decode("utf-8", "replace") for p in asked], add_special_tokens=False)
        known.update(zip(asked, [np.array(e.ids, dtype="<u4").tobytes() for e in found]))
        known.update([(p, known[m] + known[p[len(m) :]]) for p, m in stems.items()])
        local = {p: known[p] for p in local}
        out = [b"".join(map(local.__getitem__, pieces)) for pieces in cut]
        if len(known) > MOST_PIECES:
            for piece in {*asked, *stems}:
                del known[piece]
        return out


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def write_token_files(df: DataFrame, out: str, tokenizer: str, *, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Encode every whole text (null: empty), append ``end_id`` to each, and write the shards to ``out``."""
    end = struct.pack("<I", end_id)

    def row(shard: int, docs: list, bodies: list[bytes]) -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(bodies), dtype="<u4")
        payload = pack(np.array([len(b) // 4 for b in bodies], dtype=np.uint32), ids)
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([docs], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()), pa.array([payload], pa.binary())],
            names=["shard", "doc_ids", "n_tokens", "payload"],
        )

    def work(batches):
        encoder, docs, bodies, size, shard = library_encoder(tokenizer), [], [], 0, 0
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                piece = batch.slice(start, SLICE_ROWS)
                for doc, body in zip(piece.column(0).to_pylist(), encoder.encode_all(piece.column(1).to_pylist())):
                    docs.append(doc)
                    bodies.append(body + end)
                    size += len(body) // 4 + 1
                    if size >= shard_ids:
                        yield row(shard, docs, bodies)
                        docs, bodies, size, shard = [], [], 0, shard + 1
        if docs:
            yield row(shard, docs, bodies)

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id"), F.xxhash64("text"), F.col("text")]  # rows of one id are dealt by their hash, whose samples are small
    dealt = texts(df, id_col, text_col).repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order)
    shards = dealt.mapInArrow(work, "shard int, doc_ids array<long>, n_tokens long, payload binary")
    shards.select(F.spark_partition_id().alias("part"), "*").write.option("compression", "none").parquet(out)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: part, shard, place, doc_id, start, n_tokens, crc32 of its ids.

    Shards are unpacked where they lie. Starts add up in three steps: within a shard,
    over the shards of a part, over the parts, whose number Spark's setting bounds.
    """

    def work(batches):
        for batch in batches:
            for part, shard, docs, payload in zip(*(batch.column(k).to_pylist() for k in range(4))):
                packed = Shard(payload)
                ids = packed.blocks().astype("<u4").tobytes()
                ends = np.cumsum(packed.lengths.astype(np.int64))
                starts = ends - packed.lengths
                sums = [zlib.crc32(ids[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist())]
                n = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([shard] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(docs, pa.int64()),
                     pa.array(starts, pa.int64()), pa.array(packed.lengths.astype(np.int64)), pa.array(sums, pa.int64())],
                    names=["part", "shard", "place", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    shards = spark.read.schema("part int, shard int, doc_ids array<long>, n_tokens long, payload binary").parquet(path)
    rows = shards.select("part", "shard", "doc_ids", "payload").mapInArrow(
        work, "part int, shard int, place int, doc_id long, start long, n_tokens long, ids_crc32 long"
    )
    sizes = shards.select("part", "shard", "n_tokens")
    before = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    in_part = sizes.select("part", "shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("_in_part"))
    totals = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = rows.join(in_part, ["part", "shard"]).join(parts, "part")
    return placed.withColumn("start", F.col("start") + F.col("_in_part") + F.col("_before")).drop("_in_part", "_before")

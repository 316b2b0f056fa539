"""Importance resampling towards a target corpus, over hashed word n-grams.

Each block of texts is interned in an open-addressed NumPy table: xxhash64 keys, linear
probing, and a comparison of the bytes, so that two n-grams never share a slot. A slot
holds the n-gram's bucket and its count in the block; the occurrences hold slot ids. The
first pass adds the slots' counts to a histogram of the buckets, the second one gathers the
buckets' gains through the slot ids and sums them per text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import FOLD, texts, written
from tallybook.llm.ranks import ranked

BLOCK_BYTES = 2_000_000


class Interned:
    """Distinct byte strings among ``starts``/``ends`` of ``data``: a slot for each, and each occurrence's slot."""

    def __init__(self, data: bytes, starts: np.ndarray, ends: np.ndarray, buckets: int):
        body = np.frombuffer(data, dtype=np.uint8)
        pieces = [data[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        keys = np.fromiter(map(xxhash.xxh64_intdigest, pieces), dtype=np.uint64, count=len(pieces))
        size = 1 << max(4, int(2 * len(pieces)).bit_length())
        holder = np.full(size, -1, dtype=np.int64)  # the occurrence that owns the slot
        self.slot = np.zeros(len(pieces), dtype=np.int64)
        place = (keys & np.uint64(size - 1)).astype(np.int64)
        waiting = np.arange(len(pieces))
        while len(waiting):
            at = place[waiting]
            free = holder[at] < 0
            holder[at[free]] = waiting[free]  # of several, one stays
            owner = holder[at]
            same = keys[owner] == keys[waiting]
            same[same] = equal_bytes(body, starts, ends, owner[same], waiting[same])
            self.slot[waiting[same]] = at[same]
            waiting = waiting[~same]
            place[waiting] = (place[waiting] + 1) & (size - 1)
        used = np.flatnonzero(holder >= 0)
        self.bucket = np.zeros(size, dtype=np.int64)
        self.bucket[used] = [zlib.crc32(pieces[i]) % buckets for i in holder[used].tolist()]
        self.count = np.bincount(self.slot, minlength=size)


def equal_bytes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether the byte strings of two lists of occurrences are equal, pair by pair."""
    lengths = ends[one] - starts[one]
    equal = lengths == ends[other] - starts[other]
    pairs = np.flatnonzero(equal & (one != other))
    if len(pairs):
        length = lengths[pairs]
        offsets = np.cumsum(length) - length
        within = np.arange(int(length.sum())) - np.repeat(offsets, length)
        unlike = body[np.repeat(starts[one[pairs]], length) + within] != body[np.repeat(starts[other[pairs]], length) + within]
        equal[pairs] = ~np.logical_or.reduceat(unlike, offsets)
    return equal


def pieces_of(text: bytes, most: int) -> Iterator[bytes]:
    """Lower-cased text in pieces of about ``most`` bytes, cut between words; words and nothing else are kept."""
    folded = text.translate(FOLD)
    start = 0
    while len(folded) - start > most:
        cut = folded.find(b" ", start + most)
        if cut < 0:
            break
        yield b" ".join(folded[start:cut].split())
        start = cut
    yield b" ".join(folded[start:].split())


def blocks_of(rows: Iterator[bytes], longest: int, block_bytes: int) -> Iterator[tuple[list[int], list[int], bytes]]:
    """(row, words carried over, text) of pieces, gathered into blocks of about ``block_bytes``.

    A piece after the first of a row begins with the last words of the one before, so that
    n-grams across the cut are met once, in the piece in which they end.
    """
    owners: list[int] = []
    carried: list[int] = []
    body: list[bytes] = []
    held = 0
    for row, text in enumerate(rows):
        tail: list[bytes] = []
        for piece in pieces_of(text, block_bytes):
            owners.append(row)
            carried.append(len(tail))
            body.append(b" ".join([*tail, piece]) if tail else piece)
            held += len(body[-1]) + 1
            if longest > 1:
                tail = (tail + piece.split())[1 - longest :]
            if held >= block_bytes:
                yield owners, carried, b"\n".join(body)
                owners, carried, body, held = [], [], [], 0
    if owners:
        yield owners, carried, b"\n".join(body)


def occurrences(block: bytes, carried: list[int], longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and piece of every n-gram of a block, and the number of new words of each piece."""
    body = np.frombuffer(block, dtype=np.uint8)
    word = np.concatenate([[False], body > 32, [False]])
    first = np.flatnonzero(~word[:-1] & word[1:])
    last = np.flatnonzero(word[:-1] & ~word[1:])
    lines = np.flatnonzero(body == 10)
    owner = np.searchsorted(lines, first)  # line feeds stand between pieces
    words = np.bincount(owner, minlength=len(carried))
    rank = np.arange(len(first)) - (np.cumsum(words) - words)[owner]
    fresh = rank >= np.asarray(carried, dtype=np.int64)[owner]
    starts, ends, owners = [], [], []
    for n in range(1, longest + 1):
        ending = np.flatnonzero(fresh & (rank >= n - 1))
        starts.append(first[ending - (n - 1)])
        ends.append(last[ending])
        owners.append(owner[ending])
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(owners), np.bincount(owner[fresh], minlength=len(carried))


def bucket_counts(df: DataFrame, text_col: str, longest: int, buckets: int, block_bytes: int = BLOCK_BYTES) -> np.ndarray:
    """Occurrences of n-grams by bucket, over all texts. A task holds one histogram; the driver gets the sum, ``buckets`` numbers."""

    def count(batches):
        sums = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            rows = (v.as_py() for v in batch.column(0))
            for _, carried, block in blocks_of(rows, longest, block_bytes):
                starts, ends, _, _ = occurrences(block, carried, longest)
                table = Interned(block, starts, ends, buckets)
                used = table.count > 0
                np.add.at(sums, table.bucket[used], table.count[used])
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums[held])], ["bucket", "n"])

    found = texts(df.withColumn("_none", F.lit(None)), "_none", text_col).select("text").mapInArrow(count, "bucket long, n long")
    sums = np.zeros(buckets, dtype=np.int64)
    for row in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        sums[row["bucket"]] = row["n"]
    return sums


def gains_of(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the target's share of a bucket over the raw corpus's), both with one occurrence more in each bucket."""
    s, t = raw.astype(np.float64), target.astype(np.float64)
    more = np.float64(len(raw))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + more) / ((s + 1) * (t.sum() + more)))).astype(np.int64)


def weights(df: DataFrame, gains: np.ndarray, id_col: str, text_col: str, longest: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_features and weight, the sum of the gains of all n-grams of the row's text."""
    buckets = len(gains)

    def weigh(batches):
        for batch in batches:
            size = batch.num_rows
            n_words, n_features, weight = (np.zeros(size, dtype=np.int64) for _ in range(3))
            rows = (v.as_py() for v in batch.column(1))
            for owners, carried, block in blocks_of(rows, longest, block_bytes):
                starts, ends, piece, fresh = occurrences(block, carried, longest)
                table = Interned(block, starts, ends, buckets)
                row = np.asarray(owners, dtype=np.int64)
                np.add.at(n_words, row, fresh)
                np.add.at(n_features, row[piece], 1)
                np.add.at(weight, row[piece], gains[table.bucket][table.slot])
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_words, n_features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return texts(df, id_col, text_col).mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(id_col: Column, seed: str) -> Column:
    """A Gumbel number of the id, in thousandths, rounded down; the same in every run."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", longest: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: str = "2024") -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row; rank is null where the row isn't drawn.

    Of the rows with ``least_words`` words, the given percentage with the highest scores is drawn,
    which draws without replacement in proportion to exp(weight / 1000). Ties go to the lesser
    id, null ids last (their noise is that of an empty id), then in stored order. Null and empty
    texts have no features, weight 0 and are never drawn while ``least_words`` is above 0. No rows
    give no rows; an empty target gives gains all the same. Further columns are not read.
    """
    raw = bucket_counts(docs, text_col, longest, buckets)
    gains = gains_of(raw, bucket_counts(target, target_text_col, longest, buckets))
    rows = weights(docs, gains, id_col, text_col, longest)
    rows = rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("short", F.when(F.col("n_words") >= least_words, 0).otherwise(1))
    rows = ranked(written(rows, "weights"), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "short")
    drawn = (F.col("short") == 0) & (F.col("at") < F.expr(f"total * {percent} div 100"))
    return rows.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("at") + 1).alias("rank"))

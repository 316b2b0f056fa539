"""Benchmark decontamination on a distributed positional inverted index.

Shards hold the postings of some documents: the distinct words (as hashes), and for
each its sorted positions in the shard. Positions of neighbouring documents are
``GAP`` apart, so no run of words crosses documents. The index is a written table, one
row per shard, and grows with the corpus.

An item asks for its windows of ``size`` consecutive words; an item of fewer words is one
window. In each shard a window starts from the list of its rarest word, shifted by
the word's offset, and is intersected with the shifted lists of the others, the rarest
next, until nothing or the exact places are left. With ``slack`` each word may stand so many
words off its place, which gives proximity matches.

Items are sent to all shards in blocks of at most ``MOST_QUERY_WORDS`` words, one broadcast
and one pass over the index each; words of a document and item ids found in several
blocks are united. Null and empty texts have no words; items without words ask for
nothing; a null item_id counts as the empty name. Equal document rows are separate rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import SLICE_ROWS, fold_words, texts, word_hashes, written

GAP = 64
SHARD_WORDS = 1 << 18
MOST_QUERY_WORDS = 500_000
LOW = np.int64((1 << 32) - 1)


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """(shard, doc_ids, lengths, words, counts, positions) as a written table.

    ``words`` are the sorted hashes of the shard's words, ``counts`` and ``positions`` their postings;
    a document's first position is the words and gaps before it.
    """

    def row(ids: list, hashes: list[np.ndarray]) -> pa.RecordBatch:
        lengths = np.array([len(h) for h in hashes], dtype=np.int64)
        starts = np.cumsum(lengths + GAP) - lengths - GAP
        every = np.concatenate(hashes)
        places = (np.arange(len(every)) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)).astype(np.uint32)
        order = np.argsort(every, kind="stable")
        words, counts = np.unique(every[order], return_counts=True)
        return pa.RecordBatch.from_arrays(
            [pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([words.tobytes()], pa.binary()),
             pa.array([counts.astype(np.uint32).tobytes()], pa.binary()), pa.array([places[order].tobytes()], pa.binary())],
            names=["doc_ids", "lengths", "words", "counts", "positions"],
        )

    def work(batches: Iterator[pa.RecordBatch]):
        ids, hashes, size = [], [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids.append(doc)
                    hashes.append(word_hashes(fold_words(text)))
                    size += len(hashes[-1])
                    if size >= shard_words:
                        yield row(ids, hashes)
                        ids, hashes, size = [], [], 0
        if ids:
            yield row(ids, hashes)

    schema = "doc_ids array<long>, lengths array<long>, words binary, counts binary, positions binary"
    shards = texts(docs, id_col, text_col).mapInArrow(work, schema)
    return written(shards.select(F.monotonically_increasing_id().alias("shard"), "*"), "index")


class Windows:
    """The windows of a block of items: word numbers (-1 beyond a short one), lengths, item of each."""

    def __init__(self, items: list[tuple[str, bytes]], size: int):
        hashes = [word_hashes(fold_words(text)) for _, text in items]
        self.names = [name for name, _ in items]
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]))
        words, lengths, owners = [], [], []
        for owner, mine in enumerate(hashes):
            numbers = np.searchsorted(self.vocabulary, mine)
            width = min(size, len(mine))
            for start in range(len(mine) - width + 1 if width else 0):
                words.append(np.pad(numbers[start : start + width], (0, size - width), constant_values=-1))
                lengths.append(width)
                owners.append(owner)
        self.words = np.array(words, dtype=np.int64).reshape(len(words), size)
        self.lengths, self.owners = np.array(lengths, dtype=np.int64), np.array(owners, dtype=np.int64)


class Postings:
    """One shard's lists, each entry as word number and position in one sorted array."""

    def __init__(self, words: bytes, counts: bytes, positions: bytes):
        self.words = np.frombuffer(words, dtype=np.uint64)
        self.counts = np.frombuffer(counts, dtype=np.uint32).astype(np.int64)
        self.firsts = np.cumsum(self.counts) - self.counts
        self.positions = np.frombuffer(positions, dtype=np.uint32).astype(np.int64)

    def find(self, asked: Windows, slack: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Window number and place of its first word, for all occurrences."""
        none = np.zeros(0, dtype=np.int64)
        if not len(asked.words) or not len(self.words):
            return none, none
        at = np.minimum(np.searchsorted(self.words, asked.vocabulary), len(self.words) - 1)
        there = self.words[at] == asked.vocabulary
        number = np.append(np.where(there, at, -1), -2)  # -1: not in this shard, -2: beyond a short window
        own = number[asked.words]
        size = np.where(own >= 0, self.counts[own], np.where(own == -1, 0, np.iinfo(np.int64).max))
        alive = np.flatnonzero(size.min(axis=1) > 0)
        own, order = own[alive], np.argsort(size[alive], axis=1, kind="stable")
        if not len(alive):
            return none, none
        every = np.arange(len(alive))
        rarest, offset = own[every, order[:, 0]], order[:, 0]
        counts = self.counts[rarest]
        window = np.repeat(every, counts)
        entry = np.arange(len(window)) - np.repeat(np.cumsum(counts) - counts, counts) + self.firsts[rarest][window]
        start = self.positions[entry] - offset[window]
        window, start = window[start >= 0], start[start >= 0]
        used = np.unique(own[own >= 0])
        keys = np.concatenate([(np.int64(w) << 32) + self.positions[f : f + c] for w, f, c in zip(used, self.firsts[used], self.counts[used])])
        for step in range(1, order.shape[1]):
            offset = order[window, step]
            word = own[window, offset]
            target = start + offset
            key = (np.maximum(word, 0) << 32) + target
            low = (np.maximum(word, 0) << 32) + np.maximum(target - slack, 0)
            found = keys[np.minimum(np.searchsorted(keys, low), len(keys) - 1)]
            fits = (word == -2) | ((found >= low) & (found <= key + slack))
            window, start = window[fits], start[fits]
            if not len(window):
                break
        return alive[window], start


def query_blocks(items: DataFrame, id_col: str, text_col: str, most_words: int) -> list[list[tuple[str, bytes]]]:
    """The items in blocks of about ``most_words`` words (a longer item is a block), one collected at a time by the caller's loop."""
    asked = texts(items, id_col, text_col).withColumnsRenamed({"doc_id": "item_id"})
    size = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    lots = max(1, -(-size // (4 * most_words)))
    for lot in range(lots):
        part = asked.where(F.pmod(F.xxhash64("text"), F.lit(lots)) == lot) if lots > 1 else asked
        yield [("" if r["item_id"] is None else str(r["item_id"]), bytes(r["text"])) for r in part.collect()]


def search(index: DataFrame, items: DataFrame, *, id_col: str = "item_id", text_col: str = "text", size: int = 13, slack: int = 0, most_words: int = MOST_QUERY_WORDS) -> DataFrame:
    """(shard, place, hit, items): per document with matches the numbers of its words in them, and the items' names."""
    if size + slack >= GAP:
        raise ValueError(f"size and slack must stay below {GAP}")

    def work_on(broadcast):
        def work(batches: Iterator[pa.RecordBatch]):
            asked = broadcast.value
            for batch in batches:
                for shard, lengths, words, counts, positions in zip(*(c.to_pylist() for c in batch.columns)):
                    window, start = Postings(words, counts, positions).find(asked, slack)
                    if not len(window):
                        continue
                    lengths = np.array(lengths, dtype=np.int64)
                    firsts = np.cumsum(lengths + GAP) - lengths - GAP
                    # a near match may begin or end off the document
                    middle = start + asked.lengths[window] // 2
                    place = np.maximum(np.searchsorted(firsts, start, side="right") - 1, 0) if not slack else np.maximum(np.searchsorted(firsts, middle + slack, side="right") - 1, 0)
                    rows = []
                    for doc in np.unique(place):
                        mine = place == doc
                        mask = np.zeros(int(lengths[doc]) + 1, dtype=np.int64)
                        first = np.clip(start[mine] - firsts[doc], 0, lengths[doc])
                        np.add.at(mask, first, 1)
                        np.add.at(mask, np.minimum(first + asked.lengths[window[mine]], lengths[doc]), -1)
                        hit = np.flatnonzero(np.cumsum(mask)[:-1] > 0)
                        rows.append((shard, int(doc), hit, sorted({asked.names[o] for o in np.unique(asked.owners[window[mine]])})))
                    columns = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.int64())), pa.array(columns[3], pa.list_(pa.string()))],
                        names=["shard", "place", "hit", "items"],
                    )

        return work

    spark, found = index.sparkSession, None
    for block in query_blocks(items, id_col, text_col, most_words):
        broadcast = spark.sparkContext.broadcast(Windows(block, size))
        part = index.select("shard", "lengths", "words", "counts", "positions").mapInArrow(work_on(broadcast), "shard long, place long, hit array<long>, items array<string>")
        found = part if found is None else found.union(part)
    united = found.groupBy("shard", "place").agg(F.flatten(F.collect_list("hit")).alias("hit"), F.flatten(F.collect_list("items")).alias("items"))  # one row per block
    return united.select("shard", "place", F.array_distinct("hit").alias("hit"), F.array_sort(F.array_distinct("items")).alias("items"))


def contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 13, slack: int = 0, index: DataFrame | None = None, most_words: int = MOST_QUERY_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, items_sha256, contaminated of every document.

    Contaminated: a hit, and hit words make at least a twentieth of all.
    """
    index = build_index(docs, id_col=id_col, text_col=text_col) if index is None else index
    found = search(index, items, size=size, slack=slack, most_words=most_words)
    rows = index.select("shard", F.posexplode(F.arrays_zip("doc_ids", "lengths")).alias("place", "d")).select(
        "shard", F.col("place").cast("long").alias("place"), F.col("d.doc_ids").alias("doc_id"), F.col("d.lengths").alias("n_words")
    )
    none = F.array().cast("array<string>")
    joined = rows.join(found, ["shard", "place"], "left").select(
        "doc_id", "n_words", F.coalesce(F.size("hit"), F.lit(0)).cast("long").alias("hits"), F.coalesce("items", none).alias("items")
    )
    return joined.select(
        "doc_id", "n_words", F.greatest("hits", F.lit(0)).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("hits") > 0) & (20 * F.col("hits") >= F.col("n_words"))).alias("contaminated"), "items",
    )

"""Which documents hold which of many asked passages: one reading of the texts, nothing of them shuffled."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.session import written

MOST_PASSAGES = 200_000
STEP = np.uint64(0x9E3779B97F4A7C15)


def plain(text: str) -> Column:
    """Words joined by one space."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def passages_of(items: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, p): every run of ``size`` words of a text, or all words of a shorter one, joined by one space."""
    words = F.split(plain(text_col), " ")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    runs = F.transform(starts, lambda i: F.array_join(F.slice("w", i, size), " "))
    return items.select(id_col, words.alias("w")).where(F.col("w").isNotNull()).select(id_col, F.explode(runs).alias("p")).distinct()


def window_hashes(words: list[bytes], size: int) -> np.ndarray:
    """A hash of each run of ``size`` words, from a polynomial over the words' hashes; for use within one process."""
    hashes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    total = np.zeros(len(words) - size + 1, dtype=np.uint64)
    for k in range(size):
        total = total * STEP + hashes[k : len(hashes) - size + 1 + k]
    return total


class Asked:
    """Reverse index of passages: by their number of words, the sorted hashes and the passages in that order."""

    def __init__(self, passages: list[bytes]):
        by_size: dict[int, list[bytes]] = defaultdict(list)
        for p in passages:
            words = p.split()
            plain = b" ".join(words)
            by_size[len(words)].append(p if p == plain else plain)
        self.by_size = {n: self._sorted(same, n) for n, same in by_size.items()}

    @staticmethod
    def _sorted(passages: list[bytes], size: int) -> tuple[np.ndarray, list[bytes]]:
        hashes = np.fromiter((window_hashes(p.split(), size)[0] for p in passages), dtype=np.uint64, count=len(passages))
        order = np.argsort(hashes, kind="stable")
        return hashes[order], [passages[n] for n in order.tolist()]

    def held(self, text: bytes) -> set[bytes]:
        """The passages that stand in a text, word by word; an empty one stands in a text without words."""
        words = text.split()
        found: set[bytes] = set()
        for size, (hashes, known) in self.by_size.items():
            if size > len(words) or not size:
                found |= {b""} if not size and not words else set()
                continue
            windows = window_hashes(words, size)
            places = np.searchsorted(hashes, windows)
            for at in np.flatnonzero(hashes[np.minimum(places, len(hashes) - 1)] == windows).tolist():
                window, place = b" ".join(words[at : at + size]), int(places[at])
                while place < len(known) and hashes[place] == windows[at]:
                    if known[place] == window:
                        found.add(window)
                    place += 1
        return found


def passage_blocks(passages: DataFrame, most: int = MOST_PASSAGES) -> Iterator[list[bytes]]:
    """The distinct passages (p) in blocks of about ``most``, by their hash; one block at least."""
    passages = written(passages.select("p").where("p is not null").distinct(), "passages")
    blocks = max(1, -(-passages.count() // most))
    for n in range(blocks):
        rows = passages.where(F.pmod(F.xxhash64("p"), F.lit(blocks)) == n).collect()  # about ``most``
        yield [r["p"].encode() for r in rows]


def passage_hits(docs: DataFrame, id_col: str, text_col: str, blocks: Iterable[list[bytes]]) -> DataFrame:
    """(id, p): the documents and the passages (p, words joined by one space) that they hold, each pair once per row.

    Each block of passages takes one pass over the texts. Hashes find, the words themselves
    decide. Null texts hold nothing.
    """
    kind = dict(docs.dtypes)[id_col]
    source = docs.select(id_col, F.col(text_col).cast("binary").alias("_text")).where(F.col("_text").isNotNull())
    found = source.select(id_col, F.lit("").alias("p")).limit(0)

    def one_pass(asked: list[bytes]) -> DataFrame:
        def probe(batches):
            index = Asked(asked)
            for batch in batches:
                places, found = [], []
                for row, text in enumerate(batch.column(1)):
                    held = sorted(index.held(text.as_py()))
                    places += [row] * len(held)
                    found += held
                ids = batch.column(0).take(pa.array(places, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.binary()).cast(pa.string())], [id_col, "p"])

        return source.mapInArrow(probe, f"`{id_col}` {kind}, p string")

    return reduce(DataFrame.unionByName, [one_pass(b) for b in blocks] or [found])

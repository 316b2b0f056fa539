"""Quality rules: an isolation forest over rule statistics.

``rule_stats`` measures every whole text. Rows that fail the base rules are rejected. Trees of random splits are grown on a
bounded sample of the other labelled rows (about ``trees`` x ``sample`` of them, those below a threshold of their hash); the
shorter the mean path of a row, the more anomalous it is. The threshold is read from
the scores of all such rows: it finds most bad rows while at most ``false_rejects``
of the good ones go.

Null and empty texts have no words and fail the base rules. Without labels of both
kinds the forest rejects nothing. A document labelled more than once counts as bad if
any of its labels is. Equal rows get equal verdicts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import map_batches, texts, written

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
PUNCTUATION = b"!\"'()+,-./:;=?@[\\]^_`{}~"
CONTINUATION = bytes(range(128, 192))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics of the rules and the value beyond which each counts; below it a rule is silent, so that sound texts
#: of all kinds fall on one point, and only the amounts beyond it are left for the forest to split.
LIMITS = {
    "short_words": 0.0, "long_words": 0.0, "symbols": 0.1, "dup_lines": 0.3, "repeats": 0.15, "capitals": 0.3, "shouts": 0.2,
    "digits": 0.15, "punctuation": 0.5,
}
FEATURES = tuple(LIMITS)
STATS_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in FEATURES)
BINS = 1000


def repeated_words(words: list[bytes], size: int = 5) -> int:
    """Words inside windows of ``size`` words that the text holds twice or more."""
    if len(words) <= size:
        return 0
    windows = list(zip(*(words[k:] for k in range(size))))
    if len(set(windows)) == len(windows):
        return 0
    places: dict = {}
    ids = np.fromiter((places.setdefault(w, len(places)) for w in windows), dtype=np.int64, count=len(windows))
    twice = np.bincount(ids)[ids] > 1
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(covered, np.flatnonzero(twice), 1)
    np.add.at(covered, np.flatnonzero(twice) + size, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def measure(text: bytes) -> tuple:
    """The counts and features of one text."""

    def count(of: bytes) -> int:
        return len(text) - len(text.translate(None, of))

    words = text.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined.translate(None, CONTINUATION))
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    symbols, repeats = count(SYMBOLS), repeated_words(words)
    dups = len(lines) - len(set(lines))
    per, mean = max(n, 1), chars / max(n, 1)
    capitals, small = count(UPPER), count(LOWER)
    values = (
        max(0.0, 3.0 - mean), min(20.0, max(0.0, mean - 10.0)), symbols / per, dups / max(len(lines), 1), repeats / per,
        capitals / max(capitals + small, 1), count(b"!") / per, count(DIGITS) / max(chars, 1), count(PUNCTUATION) / per,
    )
    return (n, chars, symbols, dups, repeats, *(max(0.0, v - least) for v, least in zip(values, LIMITS.values())))


def rule_stats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """One row per document: the base counts and the features of the forest, and ``key`` if a column of row keys (long) is named."""
    keys = [] if key_col is None else ["key"]

    def work(batch: pa.RecordBatch):
        rows = [measure(t) for t in batch.column(1).to_pylist()]
        columns = list(zip(*rows))
        data = [pa.array(c, pa.int64()) for c in columns[: len(COUNTS)]] + [pa.array(c, pa.float64()) for c in columns[len(COUNTS) :]]
        yield pa.RecordBatch.from_arrays([batch.column(0), *data, *batch.columns[2:]], names=["doc_id", *COUNTS, *FEATURES, *keys])

    if key_col is None:
        return map_batches(texts(df, id_col, text_col), work, STATS_SCHEMA)
    return map_batches(texts(df, id_col, text_col, key_col), work, STATS_SCHEMA + ", key long")


class Forest:
    """Isolation trees in arrays: feature, cut and depth correction per node of full binary trees."""

    def __init__(self, rows: np.ndarray, trees: int, sample: int, seed: int = 7):
        self.depth = max(1, int(np.ceil(np.log2(max(sample, 2)))))
        size = 2 ** (self.depth + 1) - 1
        self.feature = np.full((trees, size), -1, dtype=np.int64)
        self.cut = np.zeros((trees, size))
        self.path = np.zeros((trees, size))
        draw = np.random.default_rng(seed)
        self.norm = self.mean_path(min(sample, len(rows)))
        for tree in range(trees):
            self.grow(tree, 0, 0, rows[draw.choice(len(rows), min(sample, len(rows)), replace=False)], draw)

    @staticmethod
    def mean_path(n: int) -> float:
        """Mean path of an unsuccessful search among n rows."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n

    def grow(self, tree: int, node: int, depth: int, rows: np.ndarray, draw) -> None:
        self.path[tree, node] = depth + self.mean_path(len(rows))
        if depth == self.depth or len(rows) < 2:
            return
        low, high = rows.min(axis=0), rows.max(axis=0)
        usable = np.flatnonzero(high > low)
        if not len(usable):
            return
        f = int(draw.choice(usable))
        cut = draw.uniform(low[f], high[f])
        self.feature[tree, node], self.cut[tree, node] = f, cut
        left = rows[:, f] <= cut
        self.grow(tree, 2 * node + 1, depth + 1, rows[left], draw)
        self.grow(tree, 2 * node + 2, depth + 1, rows[~left], draw)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly from 0 to 1."""
        if not self.norm or not len(rows):
            return np.zeros(len(rows))
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for feature, cut, path in zip(self.feature, self.cut, self.path):
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = np.where(f < 0, node, 2 * node + 1 + (rows[every, np.maximum(f, 0)] > cut[node]))
            total += path[node]
        return 2.0 ** (-total / len(self.feature) / self.norm)


def labelled(stats: DataFrame, labels: DataFrame, label_col: str) -> DataFrame:
    marks = labels.select(F.col("doc_id").cast("long"), F.col(f"`{label_col}`").cast("int").alias("good")).where("doc_id is not null and good is not null")
    return stats.join(marks.groupBy("doc_id").agg(F.min("good").alias("good")), "doc_id")


def score_rows(stats: DataFrame, forest: Forest) -> DataFrame:
    names = stats.columns

    def work(batches):
        for batch in batches:
            rows = np.column_stack([batch.column(names.index(c)).to_numpy(zero_copy_only=False) for c in FEATURES])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.scores(rows))], names=[*names, "anomaly"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema)
    return stats.mapInArrow(work, f"{fields}, anomaly double")


def threshold(scored: DataFrame, false_rejects: float) -> float:
    """Edge of best separation above which the share of good rows is within ``false_rejects``; the middle of equal ones."""
    bins = scored.groupBy(F.least(F.floor(F.col("anomaly") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).agg(
        F.count_if(F.expr("good = 1")).alias("good"), F.count_if(F.expr("good <> 1")).alias("bad")
    )
    good, bad = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for row in bins.collect():  # BINS rows at most
        good[row["bin"]], bad[row["bin"]] = row["good"], row["bad"]
    if not good.sum() or not bad.sum():
        return float("inf")
    lost, found = np.cumsum(good[::-1])[::-1] / good.sum(), np.cumsum(bad[::-1])[::-1] / bad.sum()
    gain = np.where(lost <= false_rejects, found - lost, -1.0)
    best = np.flatnonzero(gain == gain.max())
    run = best[: np.argmax(np.diff(best, append=BINS * 2) > 1) + 1]
    return float(run[0] + run[-1]) / 2 / BINS


def sampled(known: DataFrame, most: int) -> np.ndarray:
    """Statistics of about ``most`` labelled rows, those whose hash lies below a threshold that follows from their number; equal rows count once."""
    rows = known.select("doc_id", *FEATURES).distinct().withColumn("place", F.xxhash64("doc_id", *FEATURES, F.lit(3)))
    step = 1 << 20
    share = int(step * min(1.0, most / max(known.count(), 1)))
    chosen = sorted(tuple(r) for r in rows.where(F.pmod("place", F.lit(step)) < share).select("place", *FEATURES).collect())
    return np.array([r[1:] for r in chosen], dtype=np.float64).reshape(len(chosen), len(FEATURES))


def quality_verdicts(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    trees: int = 100, sample: int = 256, false_rejects: float = 0.005, key_col: str | None = None,
) -> DataFrame:
    """doc_id, base counts, base_failed, anomaly, threshold and kept of every document, and ``key`` as ``rule_stats`` has it."""
    stats = written(rule_stats(docs, id_col, text_col, key_col), "rule-stats")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    known = labelled(stats.where(~failed), labels, label_col)
    rows = sampled(known, trees * sample)
    forest = Forest(rows, trees, sample)
    limit = threshold(score_rows(known, forest), false_rejects)
    return (
        score_rows(stats, forest)
        .select("doc_id", *([] if key_col is None else ["key"]), *COUNTS, failed.alias("base_failed"), "anomaly", F.lit(limit).alias("threshold"))
        .withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < F.col("threshold")))
    )

"""Pairwise feature interaction (H statistic) of a tree model, by weighted traversal.

A leaf is a box: a range of each feature on its path. With the features S fixed, every row
goes down both branches of a split of S and takes its own branch of the others, so the leaf's
weight in the partial dependence of S is the share of rows inside the box but for its sides
of S. That weight depends only on which of the path's features lie in S. One pass over the
rows counts all of them: nodes times rows, whatever the number of features.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLIT = re.compile(r"feature (\d+) (<=|>) ([-+.0-9eE]+)")
PREDICTION = re.compile(r"Predict: ([-+.0-9eE]+)")
WEIGHT = re.compile(r"Tree \d+ \(weight ([-+.0-9eE]+)\)")

#: Rows of a task in training; each takes about 250 bytes there.
ROWS_PER_TASK = 1_000_000


@dataclass
class Leaf:
    """Value of the rows with low < x <= high for each feature of the path."""

    value: float
    sides: dict[int, tuple[float, float]]


def fit(df: DataFrame, features: list[str], label: str, trees: int = 10, depth: int = 3, seed: int = 42) -> GBTRegressionModel:
    """Boosted regression trees, trained by Spark over the whole input.

    Training keeps every part of the rows in memory and reads it whole in one task, so many
    rows are dealt into parts of at most about ROWS_PER_TASK, however large the files' own parts are.
    """
    rows = df.select(*features, label)
    if (count := rows.count()) > ROWS_PER_TASK:
        rows = rows.repartition(max(-(-count // ROWS_PER_TASK), df.sparkSession.sparkContext.defaultParallelism))
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(rows).select("features", label)
    return GBTRegressor(labelCol=label, maxIter=trees, maxDepth=depth, seed=seed).fit(rows)


def narrowed(sides: dict[int, tuple[float, float]], feature: int, below: bool, at: float) -> dict[int, tuple[float, float]]:
    low, high = sides.get(feature, (-np.inf, np.inf))
    return sides | {feature: (low, min(high, at)) if below else (max(low, at), high)}


def leaves_of_model(model: GBTRegressionModel) -> list[Leaf]:
    """The leaves of all trees, their values weighted as the model adds them."""
    found: list[Leaf] = []
    weight, path = 1.0, []
    for line in model.toDebugString.splitlines():
        depth = len(line) - len(line.lstrip())
        if tree := WEIGHT.search(line):
            weight, path = float(tree[1]), []
        elif split := SPLIT.search(line):
            path = [p for p in path if p[0] < depth] + [(depth, int(split[1]), split[2] == "<=", float(split[3]))]
        elif leaf := PREDICTION.search(line):
            sides: dict[int, tuple[float, float]] = {}
            for at, *step in path:
                if at < depth:
                    sides = narrowed(sides, *step)
            found.append(Leaf(weight * float(leaf[1]), sides))
    return found


#: A tree given by hand: a value, or (feature, threshold, tree of the rows up to it, tree of the others).
Node = float | tuple[str, float, "Node", "Node"]


def leaves_of_trees(trees: list[Node], features: list[str]) -> list[Leaf]:
    found: list[Leaf] = []
    waiting: list[tuple[Node, dict]] = [(t, {}) for t in trees]
    while waiting:
        node, sides = waiting.pop()
        if isinstance(node, tuple):
            name, at, below, above = node
            place = features.index(name)
            waiting += [(below, narrowed(sides, place, True, at)), (above, narrowed(sides, place, False, at))]
        else:
            found.append(Leaf(float(node), sides))
    return found


class Counters:
    """What is counted: rows per cell of each feature pair, and rows inside each leaf but for some sides.

    A feature's cells are the intervals between the thresholds of the trees.
    """

    def __init__(self, leaves: list[Leaf], width: int):
        at = [sorted({v for leaf in leaves for v in leaf.sides.get(f, ()) if np.isfinite(v)}) for f in range(width)]
        self.thresholds = [np.array(v) for v in at]
        self.cells = [len(v) + 1 for v in at]
        self.values = [leaf.value for leaf in leaves]
        self.boxes = [{f: self._range(f, side) for f, side in leaf.sides.items()} for leaf in leaves]
        self.pairs = list(combinations(range(width), 2))
        #: (leaf, sides left out) -> place among the counts
        self.left_out: dict[tuple[int, frozenset[int]], int] = {}
        for n, box in enumerate(self.boxes):
            for size in range(min(2, len(box)) + 1):
                for out in combinations(sorted(box), size):
                    self.left_out[n, frozenset(out)] = len(self.left_out)
        sizes = [len(self.left_out), *(self.cells[a] * self.cells[b] for a, b in self.pairs)]
        self.starts = np.cumsum([0, *sizes])

    def _range(self, feature: int, side: tuple[float, float]) -> tuple[int, int]:
        """First and last cell inside."""
        low, high = np.searchsorted(self.thresholds[feature], side)
        return int(low) + 1 if np.isfinite(side[0]) else 0, int(high) if np.isfinite(side[1]) else self.cells[feature] - 1

    def count(self, columns: list[np.ndarray]) -> np.ndarray:
        """The counters of a batch of rows, one number each."""
        places = [np.searchsorted(t, x, side="left") for t, x in zip(self.thresholds, columns)]
        counts = np.zeros(self.starts[-1], dtype=np.int64)
        for n, box in enumerate(self.boxes):
            inside = {f: (places[f] >= low) & (places[f] <= high) for f, (low, high) in box.items()}
            for size in range(min(2, len(box)) + 1):
                for out in combinations(sorted(box), size):
                    rest = [m for f, m in inside.items() if f not in out]
                    counts[self.left_out[n, frozenset(out)]] = np.logical_and.reduce(rest).sum() if rest else len(places[0])
        for start, (a, b) in zip(self.starts[1:], self.pairs):
            size = self.cells[a] * self.cells[b]
            counts[start : start + size] = np.bincount(places[a] * self.cells[b] + places[b], minlength=size)
        return counts

    def dependence(self, counts: np.ndarray, rows: int, subset: tuple[int, ...]) -> np.ndarray:
        """Partial dependence on the subset, for each of its cells."""
        total = np.zeros([self.cells[f] for f in subset])
        for n, box in enumerate(self.boxes):
            share = counts[self.left_out[n, frozenset(box) & frozenset(subset)]] / rows
            ranges = (box.get(f, (0, self.cells[f] - 1)) for f in subset)
            total[tuple(slice(low, high + 1) for low, high in ranges)] += self.values[n] * share
        return total

    def strength(self, counts: np.ndarray, place: int) -> float | None:
        """H of a pair: the part of its dependence that is not the sum of its features' own; None if it does not vary."""
        a, b = self.pairs[place]
        start, size = self.starts[1 + place], self.cells[a] * self.cells[b]
        joint = counts[start : start + size].reshape(self.cells[a], self.cells[b])
        rows = int(joint.sum())

        def centred(subset: tuple[int, ...], weights: np.ndarray) -> np.ndarray:
            values = self.dependence(counts, rows, subset)
            return values - (values * weights).sum() / rows

        both = centred((a, b), joint)
        extra = both - centred((a,), joint.sum(1))[:, None] - centred((b,), joint.sum(0))[None, :]
        whole = (joint * both * both).sum()
        return float(np.sqrt((joint * extra * extra).sum() / whole)) if whole > 0 else None


def interactions(model: GBTRegressionModel | list[Leaf], df: DataFrame, features: list[str], top_n: int = 10) -> DataFrame:
    """Strength of the ``top_n`` strongest feature pairs over all rows: feature_a, feature_b, h.

    The trees are a fitted model's, or given as leaves.
    Rows with a null feature are left out; NaN counts as above every threshold. A task holds
    one set of counters, whose number follows from the trees alone, and the driver gets their sums.
    """
    counters = Counters(model if isinstance(model, list) else leaves_of_model(model), len(features))

    def count(batches):
        sums = np.zeros(counters.starts[-1], dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                sums += counters.count([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums[held])], ["place", "n"])

    rows = df.select(*[F.col(f).cast("double").alias(f) for f in features]).where(" and ".join(f"`{f}` is not null" for f in features))
    counts = np.zeros(counters.starts[-1], dtype=np.int64)
    for row in rows.mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
        counts[row["place"]] = row["n"]
    found = []
    for place, (a, b) in enumerate(counters.pairs):
        start = counters.starts[1 + place]
        if counts[start : counters.starts[2 + place]].any():
            found.append((features[a], features[b], counters.strength(counts, place)))
    found.sort(key=lambda r: (r[2] is None, -(r[2] or 0.0), r[0], r[1]))
    return df.sparkSession.createDataFrame(found[:top_n], "feature_a string, feature_b string, h double")

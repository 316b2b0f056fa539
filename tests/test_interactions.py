"""Interaction strength by weighted traversal beside its definition."""

import math
import random
from itertools import combinations

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tallybook.operators import interactions as ia
from tallybook.operators.interactions import fit, interactions, leaves_of_model, leaves_of_trees


def value(tree, row):
    while isinstance(tree, tuple):
        name, at, below, above = tree
        tree = below if row[name] <= at else above
    return tree


def grown(rng, names, depth):
    if not depth or rng.random() < 0.2:
        return rng.choice([-2.0, -1.0, 0.5, 1.0, 3.0])
    return rng.choice(names), rng.choice([0.5, 1.5, 2.5]), grown(rng, names, depth - 1), grown(rng, names, depth - 1)


def by_definition(trees, rows, a, b):
    """Averages over all pairs of rows."""
    predict = lambda row: sum(value(t, row) for t in trees)
    known = {}

    def centred(names):
        for row in rows:
            key = tuple((n, row[n]) for n in names)
            if key not in known:
                known[key] = sum(predict(r | dict(key)) for r in rows) / len(rows)
        found = [known[tuple((n, r[n]) for n in names)] for r in rows]
        return [x - sum(found) / len(found) for x in found]

    both, one, other = centred((a, b)), centred((a,)), centred((b,))
    whole = sum(z * z for z in both)
    return math.sqrt(sum((z - x - y) ** 2 for x, y, z in zip(one, other, both)) / whole) if whole > 1e-12 else None


@pytest.mark.parametrize("seed", range(3))
def test_twenty_features(spark, seed):
    rng = random.Random(seed)
    names = [f"x{n}" for n in range(20)]
    trees = [grown(rng, names[:6] if n % 2 else names, 4) for n in range(6)]
    rows = [{n: float(rng.randint(0, 3)) for n in names} for _ in range(40)]
    data = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} double" for n in names)).repartition(3)
    got = {(r.feature_a, r.feature_b): r.h for r in interactions(leaves_of_trees(trees, names), data, names, 1000).collect()}
    assert len(got) == 190
    for pair in combinations(names[:6], 2):
        wanted = by_definition(trees, rows, *pair)
        assert got[pair] is None and wanted is None or got[pair] == pytest.approx(wanted, abs=1e-6), pair


def test_leaves_give_the_models_predictions(spark):
    rows = [(float(k % 5), float(k * 7 % 11), float(k % 3)) for k in range(60)]
    data = spark.createDataFrame(rows, "a double, b double, c double").withColumn("y", F.col("a") * F.col("b") - F.col("c"))
    model = fit(data, ["a", "b", "c"], "y", trees=5)
    leaves = leaves_of_model(model)
    for row in rows:
        inside = [x.value for x in leaves if all(low < row[f] <= high for f, (low, high) in x.sides.items())]
        assert len(inside) == 5 and sum(inside) == pytest.approx(model.predict(Vectors.dense(row)))


def test_odd_rows(spark):
    tree = ("a", 1.0, ("b", 1.0, 0.0, 1.0), ("b", 1.0, 1.0, 0.0))
    columns = "a double, b int"
    rows = [(0.0, 0), (2.0, 2), (0.0, 2), (2.0, 0), (None, 1), (1.0, None)]
    leaves = leaves_of_trees([tree], ["a", "b"])
    assert interactions(leaves, spark.createDataFrame(rows, columns), ["a", "b"]).first().h == pytest.approx(1.0)
    assert interactions(leaves, spark.createDataFrame([], columns), ["a", "b"]).count() == 0
    assert interactions(leaves, spark.createDataFrame([(3.0, 3)] * 5, columns), ["a", "b"]).first().h is None
    nan = spark.createDataFrame([(float("nan"), 0), (5.0, 0), (0.0, 0)], columns)
    assert interactions(leaves, nan, ["a", "b"]).first().h == pytest.approx(0.0)
    assert interactions(leaves_of_trees([2.0], ["a", "b"]), spark.createDataFrame(rows, columns), ["a", "b"]).first().h is None


def test_training_parts_are_bounded(spark, monkeypatch):
    """However few parts the input has, no task trains on more rows than asked; none is lost."""
    sizes = []
    train = ia.GBTRegressor.fit
    monkeypatch.setattr(ia, "ROWS_PER_TASK", 50)
    monkeypatch.setattr(ia.GBTRegressor, "fit", lambda self, rows: sizes.extend(r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()) or train(self, rows))
    rows = spark.range(1000).selectExpr("cast(id % 7 as double) a", "cast(id % 3 as double) b", "cast(id % 7 + id % 3 as double) y").coalesce(1)
    model = fit(rows, ["a", "b"], "y", trees=1)
    assert sum(sizes) == 1000 and max(sizes) <= 50 * 1.5
    assert abs(model.predict(Vectors.dense([6.0, 2.0])) - 8.0) < 1.0

"""Retrieval scoring against small worked cases and a plain BM25."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallybook.operators import retrieval as ir


def gold(spark, relevant, utilized):
    row = spark.createDataFrame([(relevant, utilized)], "r array<string>, u array<string>")
    return row.select(ir.gold_ids(F.col("r"), F.col("u"))).first()[0]


def test_gold_ids(spark):
    assert gold(spark, ["0a", "2b", "2c"], ["5a"]) == [0, 2]
    assert gold(spark, [], ["1a"]) == [1]
    assert gold(spark, [], ["x"]) is None


def test_minmax(spark):
    rows = [(1, 0, 1.0), (1, 1, 3.0), (1, 2, 2.0), (2, 0, 2.0), (2, 1, 2.0)]
    scaled = ir.minmax(spark.createDataFrame(rows, "query_id int, doc_id int, s double"), ["query_id"], ["s"])
    got = {(r.query_id, r.doc_id): r.s for r in scaled.collect()}
    assert got == {(1, 0): 0.0, (1, 1): 1.0, (1, 2): 0.5, (2, 0): 0.0, (2, 1): 0.0}


def test_hybrid_and_ties(spark):
    rows = [(1, 0, 0.9, 0.0), (1, 1, 0.1, 4.0), (1, 2, 0.5, 2.0)]
    scores = spark.createDataFrame(rows, "query_id int, doc_id int, dense double, bm25 double")
    scaled = ir.minmax(scores, ["query_id"], ["dense", "bm25"])
    ranked = ir.top_k(ir.hybrid(scaled, [0.5, 0.9]), ["alpha", "query_id"], "hybrid").collect()
    order = {a: [r.doc_id for r in sorted(ranked, key=lambda r: r.place) if r.alpha == a] for a in (0.5, 0.9)}
    assert order == {0.5: [2, 1, 0], 0.9: [0, 2, 1]}


def test_sample_is_stable(spark):
    small, spread = spark.range(500).repartition(1), spark.range(500).repartition(7)
    assert ir.seeded_sample(small, "id", 20, 7).collect() == ir.seeded_sample(spread, "id", 20, 7).collect()


def plain_bm25(question, docs, k1=1.5, b=0.75, epsilon=0.25):
    words = [[w for w in text.lower().split() if len(w) > 1] for text in docs]
    n, mean_length = len(words), sum(map(len, words)) / len(words)
    df = {}
    for doc in words:
        for w in set(doc):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = epsilon * sum(idf.values()) / len(idf)
    idf = {w: floor if v < 0 else v for w, v in idf.items()}
    scores = []
    for doc in words:
        score = 0.0
        for w in [w for w in question.lower().split() if len(w) > 1]:
            tf = doc.count(w)
            score += idf.get(w, 0.0) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(doc) / mean_length))
        scores.append(score)
    return scores


def test_bm25_matches_plain_loop(spark):
    chance = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)] + ["common"]
    questions, rows, expected = [], [], {}
    for q in range(3):
        docs = [" ".join(["common"] + [chance.choice(vocabulary) for _ in range(chance.randint(3, 40))]) for _ in range(12)]
        question = "common w1 w2 w2 absent W3"
        questions.append((q, question))
        rows += [(q, d, text) for d, text in enumerate(docs)]
        expected.update({(q, d): s for d, s in enumerate(plain_bm25(question, docs))})
    scored = ir.bm25(
        spark.createDataFrame(questions, "query_id int, question string"),
        spark.createDataFrame(rows, "query_id int, doc_id int, text string"),
    ).collect()
    assert len(scored) == 36
    for r in scored:
        assert r.bm25 == pytest.approx(expected[r.query_id, r.doc_id], abs=1e-5)


def test_improved_examples_fill_up(spark):
    base = spark.createDataFrame([(i, 1 if i in (0, 4) else 0, 1) for i in range(6)], "query_id int, hit_at_1 int, hit_at_3 int")
    better = spark.createDataFrame([(i, 1 if i == 5 else 0, 1) for i in range(6)], "query_id int, hit_at_1 int, hit_at_3 int")
    got = [r.query_id for r in ir.improved_examples(base, better).collect()]
    assert got == [5, 0, 1]


def test_hybrid_top_ranks_few_rows_and_the_right_ones(spark):
    """The best of each alpha are those of all rows ranked; most rows are left out before."""
    rng = random.Random(7)
    some = lambda: rng.choice([None, 0.0, 0.5, 1.0, rng.random()])
    rows = [(q, d, some(), some()) for q, n in enumerate([1, 2, 3, 4, 30, 400]) for d in range(n)] + [(4, 7, 1.0, 1.0), (9, None, 0.5, 0.5), (9, 1, None, None)]
    scaled = spark.createDataFrame(rows, "query_id int, doc_id int, dense double, bm25 double")
    every = ir.top_k(ir.hybrid(scaled, ir.ALPHAS), ["alpha", ir.QUERY], "hybrid")
    columns = ["alpha", "query_id", "doc_id", "dense", "bm25", "hybrid", "place"]
    found = ir.hybrid_top(scaled, ir.ALPHAS).select(columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, every.select(columns).collect()))

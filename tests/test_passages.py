"""Passage lookup and pruned BM25 beside brute force."""

import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from tallybook.operators import passages as ps
from tallybook.operators import retrieval as ir


def runs(text, size):
    words = text.split()
    return {" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


@pytest.mark.parametrize("most", [3, 10_000])
def test_hits_equal_brute_force(spark, most):
    rng = random.Random(most)
    word = lambda: rng.choice(["keel", "mast", "été", "a", "b"])
    line = lambda n: rng.choice([" ", "  ", "\n\t"]).join(word() for _ in range(n))
    items = [(k, line(rng.randint(0, 9))) for k in range(25)] + [(25, None)]
    docs = [(k, line(rng.randint(0, 40))) for k in range(60)] + [(60, None), (61, ""), (None, "a b"), (7, "keel mast a b"), (62, "mast " * 20_000)]
    asked = ps.passages_of(spark.createDataFrame(items, "item long, body string"), "item", "body", 4)
    assert {(r.item, r.p) for r in asked.collect()} == {(k, p) for k, t in items if t is not None for p in runs(t, 4)}
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc long, words string, p string").repartition(3)
    got = sorted(((r.doc, r.p) for r in ps.passage_hits(frame, "doc", "words", ps.passage_blocks(asked, most)).collect()), key=str)
    edged = [(k, " " + " ".join(t.split()) + " ") for k, t in docs if t is not None]
    wanted = {p for k, t in items if t is not None for p in runs(t, 4)}
    assert got == sorted(((k, p) for k, t in edged for p in wanted if (f" {p} " in t if p else t == "  ")), key=str)


def test_equal_hashes_do_not_decide(monkeypatch):
    monkeypatch.setattr(ps, "window_hashes", lambda words, size: ps.np.zeros(len(words) - size + 1, dtype=ps.np.uint64))
    index = ps.Asked([b"a b", b"c d", b"e"])
    assert index.held(b"x a b y d c e") == {b"a b", b"e"}


def test_no_passages(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc long, t string")
    none = spark.createDataFrame([], "p string")
    assert ps.passage_hits(docs, "doc", "t", ps.passage_blocks(none)).count() == 0
    assert ps.passage_hits(docs, "doc", "t", []).count() == 0


def test_counted_terms(spark):
    texts = ["Été K2 k2 a bb BB, b-cc", None, "", "Keel keel İx", "٣٣ 33"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, t string")
    spelled = rows.select("id", ir.tokens(F.coalesce("t", F.lit(""))).alias("w")).collect()
    got = {r.id: (r.length, {t.term: t.tf for t in r.terms}, r.held) for r in ir.count_terms(rows, "t", [b"a bb"]).collect()}
    assert got == {r.id: (len(r.w), {w: r.w.count(w) for w in r.w}, ["a bb"] if r.id == 0 else []) for r in spelled}


def test_terms_are_handed_on_in_small_parts(spark, monkeypatch):
    """A task holds the terms of few rows at once, whatever the size of the batches that it is given."""
    monkeypatch.setattr(ir, "MOST_TERMS", 30)
    rows = [(k, " ".join(f"w{n}" for n in range(k % 11)) or None) for k in range(100)]
    docs = spark.createDataFrame(rows, "id int, t string").coalesce(1)
    spy = docs.__class__.mapInArrow

    def watched(df, function, schema):
        def limited(batches):
            for part in function(batches):
                assert len(part.column("terms").flatten()) < 30 + 11
                yield part

        return spy(df, limited, schema)

    monkeypatch.setattr(docs.__class__, "mapInArrow", watched)
    got = {r.id: (r.length, sorted(t.term for t in r.terms), r.held) for r in ir.count_terms(docs, "t", [b"w0 w1"]).collect()}
    assert got == {k: (len((t or "").split()), sorted((t or "").split()), ["w0 w1"] if k % 11 > 1 else []) for k, t in rows}


def test_passages_are_kept_once():
    """Apart from the asked passages themselves an index holds a few bytes for each."""
    asked = [f"w{n} x{n} y{n}".encode() for n in range(20_000)]
    tracemalloc.start()
    index = ps.Asked(asked)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 40 * len(asked)
    assert index.held(b"a w7 x7 y7 b w8 x8 y9") == {b"w7 x7 y7"}


@pytest.mark.parametrize("seed", range(4))
def test_pruned_lists_give_the_best(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["common"]
    rows, questions = [], []
    for q in range(6):
        size = [1, 2, 5, 40, 40, 80][q]
        for d in range(size):
            words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 12))] + ["common"] * (rng.random() < 0.9)
            rows.append((q, d, " ".join(words)))
        questions.append((q, "common w1 w2 w2 w3 absent"))
    asked = spark.createDataFrame([*questions, (9, "w1"), (10, None)], "query_id long, question string")
    docs = spark.createDataFrame([*rows, (0, 99, None)], "query_id long, doc_id long, text string")
    entries = ir.impacts(asked, docs)
    every = ir.top_k(ir.summed(entries), ["query_id"], "bm25").collect()
    pruned = ir.bm25_top(asked, docs).collect()
    key = lambda r: (r.query_id, r.place, r.doc_id, r.bm25)
    assert sorted(map(key, pruned)) == sorted(map(key, every)) and pruned
    full = {(r.query_id, r.doc_id): r.bm25 for r in ir.bm25(asked, docs).collect()}
    assert all(full[r.query_id, r.doc_id] == r.bm25 for r in pruned)


def test_asked_terms_in_blocks(spark):
    docs = spark.createDataFrame([(1, d, 3, [(w, 1) for w in ("aa", "bb", "cc")]) for d in range(4)], "query_id long, doc_id long, length int, terms array<struct<term: string, tf: int>>")
    asked = spark.createDataFrame([(1, w, 1) for w in ("aa", "cc", "dd")] + [(2, "aa", 1)], "query_id long, term string, times long")
    for most in (1, 100):
        assert sorted((r.doc_id, r.term) for r in ir.postings(asked, docs, most).collect()) == [(d, w) for d in range(4) for w in ("aa", "cc")]

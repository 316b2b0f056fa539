"""Retrieval evaluation over documents, benchmark items and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.operators import retrieval as ir
from tallybook.operators.retrieval import DOC, QUERY
from tallybook.session import written
from tallybook.sources.corpus import Corpus
from tallybook.sources.tables import Tables

SMALL_DIMS = 32
SAMPLE_SIZE, SEED = 80, 42


class Inputs:
    """Questions, relevant pairs and candidates; the last two written once.

    The candidates carry their counted terms, which BM25 reads three times; the relevant
    pairs decide which documents take part.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.corpus = Corpus(Tables(spark, sf_dir))
        counted, self.gold = self.corpus.read()
        self.candidates = written(self.corpus.counted_candidates(counted, self.gold), "candidates")

    def bm25(self) -> DataFrame:
        return ir.bm25(self.corpus.questions(), self.candidates)

    def dense(self) -> DataFrame:
        return ir.dense_scores(self.corpus.question_vectors(), self.candidates)

    def scores(self, small: bool = False) -> DataFrame:
        """Dense and BM25 scores of every candidate side by side, written once."""
        scores = self.bm25().join(self.dense(), [QUERY, DOC])
        if small:
            vectors = self.corpus.question_vectors()
            scores = scores.join(ir.dense_scores(vectors, self.candidates, SMALL_DIMS, "dense_small"), [QUERY, DOC])
        return written(scores, "scores")


def inputs(spark: SparkSession, sf_dir: str, small: bool = False) -> tuple[DataFrame, DataFrame]:
    ready = Inputs(spark, sf_dir)
    return ready.scores(small), ready.gold


def ir_gold_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence keys made from each document's number; documents without any drop out."""
    n = F.col(DOC)

    def key(size: int, letter: str):
        return F.concat((n % size).cast("string"), F.lit(letter))

    empty = F.array().cast("array<string>")
    relevant = F.when(n % 3 == 0, empty).otherwise(F.array(key(4, "a"), key(5, "b"), F.lit("x1"), key(13, "c")))
    utilized = F.when(n % 6 == 0, empty).otherwise(F.array(key(7, "c"), F.lit("12"), F.lit("c3")))
    docs = Tables(spark, sf_dir)["documents"]
    gold = docs.select(DOC, ir.gold_ids(relevant, utilized).alias("gold")).filter(F.col("gold").isNotNull())
    return gold.select(DOC, F.array_join(F.transform("gold", lambda x: x.cast("string")), ",").alias("gold_doc_ids"))


def ir_clean_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Tables(spark, sf_dir)["documents"]
    framed = F.concat(F.lit(" \t\x00"), "text", F.lit(" \n "))
    return docs.select(DOC, ir.clean_doc(framed).alias("document"))


def ir_seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Tables(spark, sf_dir)["documents"].select(DOC, "lang", "source")
    return ir.seeded_sample(docs, DOC, SAMPLE_SIZE, SEED)


def ir_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Corpus(Tables(spark, sf_dir))
    return ir.corpus_stats(c.candidates(written(c.gold(), "gold")), "text")


def ir_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Inputs(spark, sf_dir).bm25()


def ir_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best documents of each question by BM25, from pruned lists."""
    ready = Inputs(spark, sf_dir)
    return ir.bm25_top(ready.corpus.questions(), ready.candidates)


def ir_dense_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Inputs(spark, sf_dir).dense()


def ir_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, _ = inputs(spark, sf_dir)
    return ir.minmax(scores, [QUERY], ["dense", "bm25"])


def dense_top(scores: DataFrame, name: str = "dense") -> DataFrame:
    return ir.top_k(scores.select(QUERY, DOC, F.col(name).alias("score")), [QUERY], "score")


def ir_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_top(Inputs(spark, sf_dir).dense())


def ir_hit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = Inputs(spark, sf_dir)
    return ir.hit_metrics(dense_top(ready.dense()), ready.gold, [QUERY])


def dense_hits(scores: DataFrame, gold: DataFrame) -> DataFrame:
    """Hits of both dense systems, one row per system and query."""
    big = ir.hit_metrics(dense_top(scores), gold, [QUERY]).withColumn("system", F.lit("dense 64"))
    small = ir.hit_metrics(dense_top(scores, "dense_small"), gold, [QUERY]).withColumn("system", F.lit("dense 32"))
    return small.unionByName(big)


def ir_recall_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, gold = inputs(spark, sf_dir, small=True)
    return ir.recall_summary(dense_hits(scores, gold), ["system"])


def ir_alpha_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ir.alpha_sweep(*inputs(spark, sf_dir)).orderBy(F.desc("recall_at_1"), F.desc("recall_at_3"), "alpha")


def ir_best_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ir.best_alpha(ir.alpha_sweep(*inputs(spark, sf_dir)))


def ir_system_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both dense systems and the best hybrid side by side."""
    scores, gold = inputs(spark, sf_dir, small=True)
    best = ir.best_alpha(ir.alpha_sweep(scores, gold))
    label = F.concat(F.lit("dense 64 + BM25 (alpha="), F.format_string("%.1f", "alpha"), F.lit(")"))
    return (
        ir.recall_summary(dense_hits(scores, gold), ["system"])
        .unionByName(best.select(label.alias("system"), "queries", "recall_at_1", "recall_at_3"))
        .orderBy(F.desc("recall_at_1"), F.desc("recall_at_3"), "system")
    )


def ir_improved_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, gold = inputs(spark, sf_dir)
    hits = ir.alpha_hits(scores, gold)
    best = ir.best_alpha(ir.recall_summary(hits, ["alpha"])).select("alpha")
    blended = hits.join(F.broadcast(best), "alpha")
    return ir.improved_examples(ir.hit_metrics(dense_top(scores), gold, [QUERY]), blended)


SUITE = {
    f.__name__: f
    for f in (
        ir_gold_ids, ir_clean_docs, ir_seeded_sample, ir_corpus_stats, ir_bm25, ir_bm25_topk, ir_dense_scores, ir_minmax, ir_topk,
        ir_hit_metrics, ir_recall_summary, ir_alpha_sweep, ir_best_alpha, ir_system_comparison, ir_improved_examples,
    )
}

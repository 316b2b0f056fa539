"""Retrieval inputs: benchmark items as questions, documents as candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.operators.passages import passage_blocks, passage_hits, passages_of
from tallybook.operators.retrieval import DOC, QUERY, clean_doc, count_terms
from tallybook.session import written
from tallybook.sources.tables import Tables

#: A document that holds so many consecutive words of an item, or all words of a shorter one, is relevant to it.
PASSAGE_WORDS = 8


class Corpus:
    """Questions, candidate documents and relevant pairs of one data directory.

    A document is a candidate of question ``doc_id mod questions`` and of every
    question of which it holds a passage; the latter are its relevant pairs.
    """

    def __init__(self, tables: Tables):
        self.t = tables

    def questions(self) -> DataFrame:
        return self.t["benchmark"].select(F.col("item_id").alias(QUERY), F.trim("text").alias("question"))

    def documents(self) -> DataFrame:
        """All documents; those without an embedding have no vector."""
        vectors = self.t["embeddings"].select(F.col("vec_id").alias(DOC), F.col("embedding").alias("vector"))
        return self.t["documents"].select(DOC, clean_doc("text").alias("text")).join(vectors, DOC, "left")

    def passages(self) -> DataFrame:
        return passages_of(self.t["benchmark"].select(F.col("item_id").alias(QUERY), "text"), QUERY, "text", PASSAGE_WORDS)

    def gold(self) -> DataFrame:
        """Relevant pairs: the asked passages are looked up while the documents are read."""
        passages = self.passages()
        hits = passage_hits(self.t["documents"], DOC, "text", passage_blocks(passages))
        return hits.join(passages, "p").select(QUERY, DOC).distinct()

    def read(self) -> tuple[DataFrame, DataFrame]:
        """All documents (doc_id, length, terms), and the relevant pairs, from one reading of the texts.

        Passages beyond the first block, if there are as many, take a further reading per block.
        """
        passages, docs = self.passages(), self.t["documents"].select(DOC, "text")
        first, *others = passage_blocks(passages)
        counted = written(count_terms(docs, "text", first), "counted")
        hits = counted.select(DOC, F.explode("held").alias("p")).unionByName(passage_hits(docs, DOC, "text", others))
        return counted.drop("held"), written(hits.join(passages, "p").select(QUERY, DOC).distinct(), "gold")

    def pairs(self, docs: DataFrame, gold: DataFrame) -> DataFrame:
        """``docs`` once for each question of which they are a candidate, if that has a relevant document.

        The question of its turn follows from the document itself; only the relevant pairs of
        other questions are looked up.
        """
        turns = self.t["benchmark"].select(F.count(F.lit(1))).scalar()
        by_turn = docs.withColumn(QUERY, F.col(DOC) % turns)
        others = docs.join(gold.where(F.col(DOC) % turns != F.col(QUERY)), DOC)
        return by_turn.unionByName(others).join(gold.select(QUERY).distinct(), QUERY, "left_semi")

    def candidates(self, gold: DataFrame | None = None) -> DataFrame:
        """Candidate documents of every question that has a relevant one."""
        gold = self.gold() if gold is None else gold
        return self.pairs(self.documents(), gold).select(QUERY, DOC, "text", "vector")

    def counted_candidates(self, counted: DataFrame, gold: DataFrame) -> DataFrame:
        """The same with ``length`` and ``terms`` for the text."""
        vectors = self.t["embeddings"].select(F.col("vec_id").alias(DOC), F.col("embedding").alias("vector"))
        return self.pairs(counted, gold).join(vectors, DOC, "left").select(QUERY, DOC, "length", "terms", "vector")

    def question_vectors(self) -> DataFrame:
        return self.t["embeddings"].select(F.col("vec_id").alias(QUERY), F.col("embedding").alias("query_vector"))

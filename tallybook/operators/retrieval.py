"""Scoring and evaluation of document retrieval: BM25, dense and hybrid."""

from __future__ import annotations

from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallybook.functions.numeric import col, ratio
from tallybook.functions.text import strip_space
from tallybook.operators.passages import Asked
from tallybook.session import written

# Parameters of Okapi BM25 and of the evaluation.
K1, B, EPSILON = 1.5, 0.75, 0.25
TOKEN = r"[a-z0-9]+"
TOKEN_BYTES = bytes(b if chr(b).isdigit() and b < 128 or 97 <= b <= 122 else 32 for b in range(256))
FLAT_SPREAD = 1e-8
TOP_K = 3
ALPHAS = [n / 10.0 for n in range(11)]

QUERY, DOC = "query_id", "doc_id"
SCORE_DIGITS = 6
#: Asked terms (of one question each) sent to the documents at once.
MOST_ASKED = 500_000
#: Counted terms that a task holds before it hands on the rows read so far.
MOST_TERMS = 50_000


def leading_numbers(keys: Column) -> Column:
    """Integers at the start of sentence keys; keys without one, or with one beyond 64 bits, are dropped."""
    found = F.transform(keys, lambda k: F.nullif(F.regexp_extract(k, r"^(\d+)", 1), F.lit("")).try_cast("long"))
    return F.array_distinct(F.filter(found, lambda n: n.isNotNull()))


def gold_ids(relevant: Column, utilized: Column) -> Column:
    """Sorted relevant document numbers, else utilised ones, else NULL."""
    first, second = leading_numbers(relevant), leading_numbers(utilized)
    chosen = F.when(F.size(first) > 0, first).when(F.size(second) > 0, second)
    return F.array_sort(chosen)


def clean_doc(text: Column | str) -> Column:
    """NUL characters become spaces; white space at the ends goes."""
    return strip_space(F.translate(col(text), "\x00", " "))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows fixed by the seed whatever the partitioning, in key order."""
    mark = F.sha2(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))), 256)
    return df.orderBy(mark, key).limit(n).orderBy(key)


def corpus_stats(candidates: DataFrame, text: str) -> DataFrame:
    """Average candidates per example and average document length."""
    per_query = candidates.groupBy(QUERY).agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length(text)).alias("chars"))
    return per_query.agg(
        F.count(F.lit(1)).alias("examples"),
        ratio(F.sum("docs"), F.count(F.lit(1))).alias("avg_candidates"),
        ratio(F.sum("chars"), F.sum("docs")).alias("avg_chars"),
    )


def tokens(text: Column | str) -> Column:
    """Lower-case ASCII words of two characters or more."""
    words = F.regexp_extract_all(F.lower(col(text)), F.lit(TOKEN), F.lit(0))
    return F.filter(words, lambda w: F.length(w) > 1)


def count_terms(df: DataFrame, text_col: str, asked: list[bytes] | None = None) -> DataFrame:
    """``df`` with ``length``, its text's number of tokens, and ``terms``, each distinct one with its count, for the text column.

    With ``asked`` passages also ``held``, those that the text holds, found in the same reading.
    """
    keep = [c for c in df.columns if c != text_col]
    kinds = dict(df.dtypes)

    def counted(rows: pa.RecordBatch, lengths: list, offsets: list, terms: list, counts: list, held: list) -> pa.RecordBatch:
        each = pa.StructArray.from_arrays([pa.array(terms, pa.binary()).cast(pa.string()), pa.array(counts, pa.int32())], ["term", "tf"])
        columns = [*rows.columns[: len(keep)], pa.array(lengths, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), each)]
        names = [*keep, "length", "terms"]
        if asked is not None:
            columns.append(pa.array(held, pa.list_(pa.binary())).cast(pa.list_(pa.string())))
            names.append("held")
        return pa.RecordBatch.from_arrays(columns, names)

    def count(batches):
        index = Asked(asked or [])
        for batch in batches:
            first, lengths, offsets, terms, counts, held = 0, [], [0], [], [], []
            for row, scalar in enumerate(batch.column(len(keep))):
                text = scalar.as_py()
                found = Counter((text or "").lower().encode().translate(TOKEN_BYTES).split())
                for single in [w for w in found if len(w) == 1]:
                    del found[single]
                lengths.append(found.total())
                terms += found
                counts += found.values()
                offsets.append(len(terms))
                held.append([] if text is None else sorted(index.held(text.encode())))
                if len(terms) >= MOST_TERMS or row + 1 == batch.num_rows:
                    yield counted(batch.slice(first, len(lengths)), lengths, offsets, terms, counts, held)
                    first, lengths, offsets, terms, counts, held = row + 1, [], [0], [], [], []

    extra = ["length int", "terms array<struct<term: string, tf: int>>", *(["held array<string>"] if asked is not None else [])]
    return df.select(*keep, text_col).mapInArrow(count, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *extra]))


def postings(asked: DataFrame, docs: DataFrame, most: int = MOST_ASKED) -> DataFrame:
    """(query, doc, length, term, tf, times) of the asked terms (query, term, times) only.

    The asked terms are sent to the documents in blocks of about ``most`` rows, by their hash,
    one pass over the counted terms each; no other term leaves its task.
    """
    each = docs.select(QUERY, DOC, "length", F.explode("terms").alias("t")).select(QUERY, DOC, "length", "t.term", "t.tf")
    blocks = max(1, -(-asked.count() // most))
    block = F.pmod(F.xxhash64(QUERY, "term"), F.lit(blocks))
    return reduce(DataFrame.unionByName, [each.join(F.broadcast(asked.where(block == n)), [QUERY, "term"]) for n in range(blocks)])


def impacts(queries: DataFrame, candidates: DataFrame, k1: float = K1, b: float = B, epsilon: float = EPSILON) -> DataFrame:
    """(query, doc, term, impact): the inverted lists of the asked terms, with what each entry adds to its document's BM25.

    A term that more than half of a question's candidates hold weighs ``epsilon`` of the mean
    over all terms; only for questions that ask such a term are all terms counted.
    """
    docs = candidates if "terms" in candidates.columns else count_terms(candidates.select(QUERY, DOC, "text"), "text")
    asked = queries.select(QUERY, F.explode(tokens("question")).alias("term")).groupBy(QUERY, "term").agg(F.count(F.lit(1)).alias("times"))
    lists = written(postings(asked, docs), "postings")
    corpus = docs.groupBy(QUERY).agg(F.count(F.lit(1)).alias("n"), ratio(F.sum("length"), F.count(F.lit(1))).alias("avg_length"))
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    known = lists.groupBy(QUERY, "term").agg(F.count(F.lit(1)).alias("df"), F.first("times").alias("times")).join(corpus, QUERY).withColumn("idf", raw)
    known = written(known, "asked-terms")
    common = docs.join(known.where("idf < 0").select(QUERY).distinct(), QUERY, "left_semi")
    counted = common.select(QUERY, F.explode("terms.term").alias("term")).groupBy(QUERY, "term").agg(F.count(F.lit(1)).alias("df"))
    floor = counted.join(corpus, QUERY).groupBy(QUERY).agg((F.avg(raw) * epsilon).alias("floor"))
    weight = F.when(F.col("idf") < 0, F.col("floor")).otherwise(F.col("idf")) * F.col("times")
    weights = known.join(floor, QUERY, "left").select(QUERY, "term", "avg_length", weight.alias("weight"))
    damped = F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg_length"))
    impact = F.col("weight") * F.col("tf") * (k1 + 1) / damped
    return lists.drop("times").join(weights, [QUERY, "term"]).select(QUERY, DOC, "term", impact.alias("impact"))


def summed(entries: DataFrame) -> DataFrame:
    return entries.groupBy(QUERY, DOC).agg(F.round(F.sum("impact"), SCORE_DIGITS).alias("bm25"))


def bm25(queries: DataFrame, candidates: DataFrame, k1: float = K1, b: float = B, epsilon: float = EPSILON) -> DataFrame:
    """BM25 of each question against its own candidate documents, zero where a document holds no asked term.

    Candidates carry their ``text`` or, when it was counted before, ``length`` and ``terms``.
    """
    scored = summed(impacts(queries, candidates, k1, b, epsilon))
    return candidates.select(QUERY, DOC).join(scored, [QUERY, DOC], "left").fillna(0.0, "bm25")


def bm25_top(queries: DataFrame, candidates: DataFrame, k: int = TOP_K) -> DataFrame:
    """The ``k`` best documents of each question among those that hold an asked term; ties as in ``top_k``.

    Lists are pruned by their bounds. A document reaches at least its largest entry (and the
    negative entries that it may have), so the k-th largest of those is a score that the k best
    documents reach. Lists in the order of their largest entries whose bounds together stay below it
    cannot bring in a document by themselves: only documents of the other lists are summed.
    """
    entries = written(impacts(queries, candidates), "impacts")
    bounds = entries.groupBy(QUERY, "term").agg(F.greatest(F.max("impact"), F.lit(0.0)).alias("bound"), F.least(F.min("impact"), F.lit(0.0)).alias("least"))
    best = entries.groupBy(QUERY, DOC).agg(F.max("impact").alias("largest"))
    place = F.row_number().over(W.partitionBy(QUERY).orderBy(F.desc("largest")))
    kth = best.withColumn("place", place).where(F.col("place") <= k).where(F.col("place") == k).select(QUERY, "largest")
    reached = kth.join(bounds.groupBy(QUERY).agg(F.sum("least").alias("losses")), QUERY)
    reached = reached.select(QUERY, (F.col("largest") + F.col("losses") - 10.0**-SCORE_DIGITS).alias("reached"))
    together = F.sum("bound").over(W.partitionBy(QUERY).orderBy("bound", "term").rowsBetween(W.unboundedPreceding, 0))
    lists = bounds.withColumn("together", together).join(reached, QUERY, "left")
    needed = lists.where(F.col("reached").isNull() | (F.col("together") >= F.col("reached"))).select(QUERY, "term")
    found = entries.join(needed, [QUERY, "term"], "left_semi").select(QUERY, DOC).distinct()
    return top_k(summed(entries.join(found, [QUERY, DOC], "left_semi")), [QUERY], "bm25", k)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def dense_scores(vectors: DataFrame, candidates: DataFrame, dims: int | None = None, name: str = "dense") -> DataFrame:
    """Similarity of question and document vectors, optionally of the first dims; NULL where one is missing."""
    doc, query = F.col("vector"), F.col("query_vector")
    if dims:
        doc, query = F.slice(doc, 1, dims), F.slice(query, 1, dims)
    return candidates.join(vectors, QUERY, "left").select(QUERY, DOC, F.round(dot(doc, query), SCORE_DIGITS).alias(name))


def minmax(scores: DataFrame, part_cols: list[str], score_cols: list[str]) -> DataFrame:
    """Scores scaled to [0, 1] within each part; a flat part becomes zero.

    Bounds come from an aggregation joined back, not a window over the part, so
    a part may be larger than one task.
    """
    bounds = scores.groupBy(*part_cols).agg(
        *[bound(c).alias(f"_{tag}_{c}") for c in score_cols for tag, bound in (("lo", F.min), ("hi", F.max))]
    )
    scaled = scores.join(bounds, part_cols)
    for c in score_cols:
        spread = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        value = F.when(spread <= FLAT_SPREAD, F.lit(0.0)).otherwise((F.col(c) - F.col(f"_lo_{c}")) / spread)
        scaled = scaled.withColumn(c, value)
    return scaled.select(*scores.columns)


def top_k(scores: DataFrame, part_cols: list[str], score: str, k: int = TOP_K) -> DataFrame:
    """Best ``k`` documents per part; equal scores put the higher document first, missing ones are not ranked."""
    scores = scores.filter(F.col(score).isNotNull())
    order = W.partitionBy(*part_cols).orderBy(F.desc(score), F.desc(DOC))
    return scores.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def hit_metrics(ranked: DataFrame, gold: DataFrame, part_cols: list[str]) -> DataFrame:
    """Whether the first, or any of the first three, is a relevant document."""
    marked = ranked.join(gold.select(QUERY, DOC, F.lit(1).alias("is_gold")), [QUERY, DOC], "left")
    hit = F.col("is_gold").isNotNull()
    return marked.groupBy(*part_cols).agg(
        F.max(F.when(hit & (F.col("place") <= 1), 1).otherwise(0)).alias("hit_at_1"),
        F.max(F.when(hit & (F.col("place") <= 3), 1).otherwise(0)).alias("hit_at_3"),
    )


def percent(hits: str) -> Column:
    return F.round(ratio(F.lit(100) * F.sum(hits), F.count(F.lit(1))), 1)


def recall_summary(hits: DataFrame, keys: list[str]) -> DataFrame:
    return hits.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("queries"), percent("hit_at_1").alias("recall_at_1"), percent("hit_at_3").alias("recall_at_3")
    )


def blend(alpha: Column | float) -> Column:
    """Blended score of scaled dense and BM25 scores; a missing dense score counts as the least."""
    alpha = F.lit(alpha) if isinstance(alpha, float) else alpha
    return alpha * F.coalesce("dense", F.lit(0.0)) + (1.0 - alpha) * F.col("bm25")


def hybrid(scaled: DataFrame, alphas: list[float]) -> DataFrame:
    """Blended score of every alpha from scaled dense and BM25 scores."""
    each = scaled.withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in alphas])))
    return each.withColumn("hybrid", blend(F.col("alpha")))


def hybrid_top(scaled: DataFrame, alphas: list[float], k: int = TOP_K) -> DataFrame:
    """The ``k`` best documents of each alpha and question by blended score.

    A question's documents are dealt into ``k`` shares; the least of the shares' best scores is
    one that ``k`` rows reach, so only rows that reach it under some alpha are ranked. A question
    with fewer shares keeps all its rows.
    """
    share = F.pmod(F.xxhash64(DOC), F.lit(k))
    best = scaled.groupBy(QUERY, share.alias("share")).agg(*[F.max(blend(a)).alias(f"_{n}") for n, a in enumerate(alphas)])
    full = F.count(F.lit(1)) == k
    reached = best.groupBy(QUERY).agg(F.when(full, F.array(*[F.min(F.coalesce(f"_{n}", F.lit(float("-inf")))) for n in range(len(alphas))])).alias("reached"))
    scores = F.array(*[F.struct(F.lit(a).alias("alpha"), blend(a).alias("hybrid")) for a in alphas])
    able = F.filter(scores, lambda s, n: F.coalesce(s["hybrid"] >= F.get("reached", n), F.col("reached").isNull()))
    each = scaled.join(reached, QUERY).select(*scaled.columns, F.explode(able).alias("s")).select(*scaled.columns, "s.alpha", "s.hybrid")
    return top_k(each, ["alpha", QUERY], "hybrid", k)


def alpha_hits(scores: DataFrame, gold: DataFrame, alphas: list[float] = ALPHAS) -> DataFrame:
    """Hits of each query under each alpha."""
    scaled = minmax(scores.select(QUERY, DOC, "dense", "bm25"), [QUERY], ["dense", "bm25"])
    return hit_metrics(hybrid_top(scaled, alphas), gold, ["alpha", QUERY])


def alpha_sweep(scores: DataFrame, gold: DataFrame, alphas: list[float] = ALPHAS) -> DataFrame:
    return recall_summary(alpha_hits(scores, gold, alphas), ["alpha"])


def best_alpha(sweep: DataFrame) -> DataFrame:
    """Highest recall at 1, then at 3, then the alpha nearest one half."""
    distance = F.abs(F.col("alpha") - 0.5)
    return sweep.orderBy(F.desc("recall_at_1"), F.desc("recall_at_3"), distance, "alpha").limit(1)


def improved_examples(base_hits: DataFrame, hybrid_hits: DataFrame, n: int = 3) -> DataFrame:
    """Queries the hybrid wins at rank one, filled up with the first others."""
    base = base_hits.select(QUERY, F.col("hit_at_1").alias("dense_hit"))
    both = hybrid_hits.select(QUERY, F.col("hit_at_1").alias("hybrid_hit")).join(base, QUERY)
    return (
        both.withColumn("improved", F.col("hybrid_hit") > F.col("dense_hit"))
        .orderBy(F.desc("improved"), QUERY)
        .limit(n)
    )

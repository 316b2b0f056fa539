"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Labels are learned only from rows outside the held-out fifth (crc32 of doc_id as text,
modulo 5, is not 0), from at most about ``most_rows`` of them, chosen by hash; that bound is
the only one. From four fifths of those the lexicon is learned (words and word beginnings
that are much more frequent in toxic texts), to which a small fixed list is added, and
the trees are grown; the others calibrate the trees' output. Every whole text is scored.

Features: densities of lexicon words and beginnings, their densest stretch, words of
the second person and how often they stand near lexicon words, shares of capitals and
upper-case words, punctuation, digits, and rates of obfuscated words (digits or
symbols inside letters, also when they read as lexicon words). Null and empty texts
have all rates 0 and get the score of such texts. If the labels hold one class only,
every score is that class. A document labelled more than once is toxic if any label is.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import fold_words, map_batches, texts, written

#: Words of abuse that need no evidence, and words of the second person in the corpus's languages.
ABUSE = frozenset(
    b"idiot idiots moron morons stupid dumb loser losers scum trash pathetic worthless disgusting imbecile cretin jerk fool filthy vermin "
    b"idiota imbecil estupido idiote connard salaud abruti ordure dummkopf arschloch abschaum trottel".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi vous votre vos du dich dir dein deine ihr euch usted ustedes tus vosotros".encode().split())
#: How obfuscated letters read.
READS_AS = bytes.maketrans(b"013457@$!|", b"oieastasil")
OBFUSCATED = re.compile(rb"[A-Za-z]+(?:[0-9@$!*|._\-]+[A-Za-z]+)+")
STEM = 5
UPPER, DIGITS, PUNCTUATION = bytes(range(65, 91)), bytes(range(48, 58)), b"!?.,;:\"'()-"
FEATURES = (
    "lexicon", "stems", "either", "count", "densest", "second_person", "near_second_person", "capitals", "shouted", "exclaims", "questions",
    "punctuation", "digits", "obfuscated", "obfuscated_lexicon", "word_length", "length",
)


def features(text: bytes, lexicon: frozenset, stems: frozenset) -> tuple:
    words = fold_words(text)
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)

    def count(of: bytes) -> int:
        return len(text) - len(text.translate(None, of))

    known = np.fromiter(map(lexicon.__contains__, words), dtype=bool, count=n)
    begun = np.fromiter(map(stems.__contains__, [w[:STEM] for w in words]), dtype=bool, count=n)
    either = known | begun
    hits = np.flatnonzero(either)
    densest = near = 0
    you = np.fromiter(map(SECOND_PERSON.__contains__, words), dtype=bool, count=n)
    if len(hits):
        densest = int((np.searchsorted(hits, hits + 40) - np.arange(len(hits))).max())
        at = np.flatnonzero(you)
        near = int((np.searchsorted(at, hits + 6) > np.searchsorted(at, hits - 5)).sum())
    odd = OBFUSCATED.findall(text)
    read = [w.translate(READS_AS).translate(None, b"*._-").lower() for w in odd]
    chars = max(len(text), 1)
    shouted = sum(map(bytes.isupper, text.split()))
    return (
        known.sum() / n, begun.sum() / n, len(hits) / n, float(min(len(hits), 20)), float(min(densest, 20)), you.sum() / n, near / n,
        count(UPPER) / chars, shouted / n, count(b"!") / n, count(b"?") / n, count(PUNCTUATION) / chars, count(DIGITS) / chars, len(odd) / n,
        sum(map(lexicon.__contains__, read)) / n, chars / n, float(np.log1p(n)),
    )


def feature_rows(df: DataFrame, lexicon: frozenset, stems: frozenset) -> DataFrame:
    """The columns of (doc_id, text, ..) without the text, and ``x``, the features as an array."""
    others = [c for c in df.columns if c != "text"]

    def work(batch: pa.RecordBatch):
        rows = [list(map(float, features(t, lexicon, stems))) for t in batch.column(batch.schema.names.index("text")).to_pylist()]
        kept = [batch.column(batch.schema.names.index(c)) for c in others]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(rows, pa.list_(pa.float64()))], names=[*others, "x"])

    fields = ", ".join(f"{c} {dict(df.dtypes)[c]}" for c in others)
    return map_batches(df, work, f"{fields}, x array<double>")


def learn_lexicon(train: DataFrame, least: int = 8, support: float = 0.003, odds: float = 8.0, most_words: int = 5000) -> tuple[frozenset, frozenset]:
    """Words and word beginnings that mark toxic texts, from (toxic, text)."""

    def work(batches):
        for batch in batches:
            toxic: dict[bytes, int] = {}
            clean: dict[bytes, int] = {}
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(fold_words(text))
                into = toxic if label else clean
                for word in [*words, *{b"^" + w[:STEM] for w in words if len(w) > STEM}]:
                    into[word] = into.get(word, 0) + 1
            keys = [*(toxic.keys() | clean.keys())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array([toxic.get(k, 0) for k in keys], pa.int64()), pa.array([clean.get(k, 0) for k in keys], pa.int64())],
                names=["word", "toxic", "clean"],
            )

    size = train.agg(F.count_if("toxic").alias("toxic"), F.count_if(~F.col("toxic")).alias("clean")).first()
    words = train.select("toxic", "text").mapInArrow(work, "word binary, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    enough = (F.col("toxic") >= max(least, support * size["toxic"])) & ((F.col("toxic") + 0.5) / (size["toxic"] + 1) >= odds * (F.col("clean") + 0.5) / (size["clean"] + 1))
    marks = [bytes(r["word"]) for r in words.where(enough).orderBy(F.desc("toxic"), "word").limit(most_words).collect()]  # most_words at most
    return frozenset(m for m in marks if m[:1] != b"^") | ABUSE, frozenset(m[1:] for m in marks if m[:1] == b"^")


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = 40_000, trees: int = 20, depth: int = 4
) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every document."""
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("mark")).where("doc_id is not null and mark is not null")
    marks = marks.groupBy("doc_id").agg((F.max("mark") > 0).alias("toxic")).withColumn("fold", fold).where("fold <> 0")
    total = marks.count()
    step = 1 << 20
    marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) < int(step * min(1.0, most_rows / max(total, 1))))
    rows = texts(docs, id_col, text_col)
    train = written(rows.join(F.broadcast(marks), "doc_id"), "toxicity-train")  # about most_rows of them, so no text is shuffled
    grow, tune = train.where("fold <> 4"), train.where("fold = 4")
    kinds = {(r["tune"], r["toxic"]): r["n"] for r in train.groupBy((F.col("fold") == 4).alias("tune"), "toxic").agg(F.count("*").alias("n")).collect()}
    held_out = (fold == 0).alias("held_out")
    if not (kinds.get((False, True)) and kinds.get((False, False))):
        only = 1.0 if any(toxic for _, toxic in kinds) else 0.0
        return rows.select("doc_id", held_out, F.lit(only).alias("score"), F.lit(int(only)).alias("predicted"))
    lexicon, stems = learn_lexicon(grow)
    vector = array_to_vector("x").alias("features")
    measured = feature_rows(train.select("doc_id", "toxic", "fold", "text"), lexicon, stems).select("fold", F.col("toxic").cast("double").alias("label"), vector)
    measured = written(measured.withColumn("features", vector_to_array("features")), "toxicity-features").withColumn("features", array_to_vector("features"))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=17, maxBins=64).fit(measured.where("fold <> 4"))
    raw = lambda df: model.transform(df).withColumn("raw", vector_to_array("probability")[1])
    calibrated = None
    if kinds.get((True, True)) and kinds.get((True, False)):
        calibrated = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(raw(measured.where("fold = 4")).select("raw", "label"))
    scored = raw(feature_rows(rows, lexicon, stems).select("doc_id", vector)).select("doc_id", "raw")
    scored = calibrated.transform(scored) if calibrated else scored.withColumn("score", F.col("raw"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    return scored.select("doc_id", held_out, score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

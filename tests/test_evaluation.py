"""Answer evaluation: calibration cases, quirks of the literal number rule, metrics."""

import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from tallybook.functions.text import compare_numeric, extract_numbers, format_scalar, normalize_text, strip_accents
from tallybook.operators import evaluation as ev

CASES = [
    # expected, actual, literal reading, intended reading
    ("64", "We counted 64 open tickets in the queue.", True, True),
    ("64", "We counted 46 open tickets.", False, False),
    ("7,654,321.40", "Freight costs came to $7,654,322.", None, True),
    ("38%", "The share of late parcels is 0.38.", None, True),
    ("Stock on hand is worth $5,600,000.", "Stock: $5.6M.", None, True),
]


def one(spark, *columns, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(*columns).first()


@pytest.mark.parametrize("expected, actual, literal, intended", CASES)
def test_numeric_comparison(spark, expected, actual, literal, intended):
    got = one(
        spark,
        compare_numeric("e", "a", intended=False).alias("literal"),
        compare_numeric("e", "a").alias("intended"),
        e=expected,
        a=actual,
    )
    assert (got.literal, got.intended) == (literal, intended)


def test_extract_numbers(spark):
    got = one(spark, extract_numbers("t").alias("v"), t="R$ 1,234.5 and 2.4M, 72% or -3; 5kg")
    assert got.v == [1234.5, 2_400_000.0, 72.0, 0.72, -3.0, 5.0]


def test_normalize_text(spark):
    got = one(spark, normalize_text("t").alias("v"), t="  São `Paulo`!! 50% of\tA/B-c.d  ")
    assert got.v == "sao paulo 50% of a/b-c.d"
    folded = one(spark, normalize_text("t").alias("v"), extract_numbers("t").alias("n"), t="\uff11\uff12 \uff21\uff22 o\ufb03ce \u2122 x\u00b2 \u212b")
    assert folded.v == "12 ab office tm x2 a" and folded.n == [12.0, 2.0]


def test_folding_of_every_code_point(spark):
    """As the standard decomposes them, without combining marks; 250 characters a row, in two orders."""
    codes = [c for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    rows = ["".join(map(chr, codes[at : at + 250])) for at in range(0, len(codes), 250)]
    rows += ["".join(map(chr, codes[at::977])) for at in range(0, 977, 7)]
    bare = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    got = spark.createDataFrame([(n, t) for n, t in enumerate(rows)], "n int, t string").select("n", strip_accents("t").alias("f")).collect()
    assert all(r.f == bare(rows[r.n]) for r in got) and len(got) == len(rows)


def test_folding_of_odd_texts(spark):
    texts = ["", None, "plain", "\uac01\u11a8 x", "\u0301", "\u00bd\u00bd", "a" * 100_000 + "\ufb01", "\ud55c\uae00 " * 20_000]
    got = {r.n: r.f for r in spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string").select("n", strip_accents("t").alias("f")).collect()}
    assert got == {n: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)) for n, t in enumerate(texts)}


def test_scalars_of_any_size(spark):
    row = spark.createDataFrame([(1e20, float("nan"), 2.5, None)], "a double, b double, c double, d double")
    got = row.select(*[format_scalar(F.col(c), "double").alias(c) for c in "abcd"]).first()
    assert tuple(got) == ("100000000000000000000", "NaN", "2.5", "null")


def test_no_results_and_undecided(spark):
    rows = spark.createDataFrame(
        [
            (1, "No results", "No matching records were found for the rule.", "scalar"),
            (2, "Sao Paulo", "são paulo", "single_entity"),
            (3, "150", "It is 150.", "ranked_list"),
        ],
        "id int, e string, a string, s string",
    )
    verdict = ev.deterministic_verdict(F.col("e"), F.col("a"), F.col("s"))
    got = {r.id: r.v.reason_code if r.v else None for r in rows.select("id", verdict.alias("v")).collect()}
    assert got == {1: "heuristic_no_results_match", 2: "heuristic_exact_match", 3: None}


def test_calibration_metrics(spark):
    counts = {("yes", "yes"): 6, ("yes", "no"): 1, ("no", "yes"): 2, ("no", "no"): 6}
    rows = [pair for pair, n in counts.items() for _ in range(n)]
    cases = spark.createDataFrame(rows, "expected_verdict string, judge_verdict string")
    metrics = ev.calibration_metrics(cases).first()
    assert (metrics.tp, metrics.fn, metrics.fp, metrics.tn) == (6, 1, 2, 6)
    assert metrics.judge_accuracy == pytest.approx(0.8)
    assert metrics.judge_precision == pytest.approx(0.75)
    assert metrics.judge_recall == pytest.approx(6 / 7)
    assert metrics.judge_f1 == pytest.approx(0.8)
    assert metrics.judge_fpr == pytest.approx(0.25)
    assert metrics.reliability == "moderate"
    rate = ev.corrected_rate(F.lit(0.6), F.lit(6 / 7), F.lit(0.25))
    assert spark.range(1).select(rate).first()[0] == pytest.approx(0.576471, abs=1e-6)


def test_metrics_of_no_cases(spark):
    empty = spark.createDataFrame([], "expected_verdict string, judge_verdict string")
    metrics = ev.calibration_metrics(empty).first()
    assert metrics.cases == 0 and metrics.judge_f1 == 0.0 and metrics.judge_accuracy is None


def test_judge_payloads(spark):
    raw = [
        (1, '```json\n{"verdict": "Yes.", "numeric_match": "TRUE", "rank_match": 0}\n```'),
        (2, 'text before {"verdict": "no"} text after'),
        (3, '{"reason_code": "x"}'),
        (4, "no object"),
        (5, '{"verdict": "perhaps", "entity_match": "sometimes"}'),
    ]
    rows = ev.parse_judge_payload(spark.createDataFrame(raw, "id int, raw string"), "raw").collect()
    got = {r.id: r for r in rows}
    assert [got[i].verdict for i in range(1, 6)] == ["yes", "no", "no", None, "unexpected"]
    assert (got[1].numeric_match, got[1].rank_match, got[5].entity_match) == (True, False, None)
    assert [got[i].parse_ok for i in range(1, 6)] == [True, True, True, False, True]


def test_format_answer_shapes(spark):
    questions = spark.createDataFrame([("a",), ("b",), ("c",)], "q string")
    rows = spark.createDataFrame([("a", 1, 2.0), ("b", 1, 1.5), ("b", 2, None)], "q string, n int, v double")
    got = {r.q: r.answer_text for r in ev.format_answer(questions, rows, "q", "n", ["v"]).collect()}
    assert got == {"a": "2", "b": "1. v: 1.5\n2. v: null", "c": "No results"}


def test_format_scalar(spark):
    row = spark.range(1).select(*[format_scalar(F.lit(v), "double") for v in (3.0, -2.0, 0.1234567, 1234567.25)]).first()
    assert list(row) == ["3", "-2", "0.123457", "1234567.25"]


def test_fingerprint_ignores_order(spark):
    rows = [(i, f"t{i % 7}", None if i % 3 else "x") for i in range(200)]
    columns = ["a", "b", "c"]
    first = spark.createDataFrame(rows, "a int, b string, c string")
    second = spark.createDataFrame(rows[::-1], "a int, b string, c string").repartition(5)
    changed = spark.createDataFrame(rows[:-1] + [(199, "other", None)], "a int, b string, c string")
    assert ev.fingerprint(first, columns).first() == ev.fingerprint(second, columns).first()
    assert ev.fingerprint(first, columns).first() != ev.fingerprint(changed, columns).first()

"""Scoring of model answers against truth, corrected by judge calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.numeric import count_if, ratio
from tallybook.functions.text import bound, compare_folded, fold, format_scalar, normalized

# Wording and labels of the answer checks.
NO_RESULTS = "No results"
NO_RESULT_MARKERS = ("no results", "no matching", "no records", "unable to find", "could not find")
PASS_WORDS = ("true", "yes", "1", "pass", "passed", "correct")
FAIL_WORDS = ("false", "no", "0", "fail", "failed", "incorrect")
TRUE_WORDS = ("true", "yes", "1")
FALSE_WORDS = ("false", "no", "0")
MATCH_FIELDS = ("numeric_match", "entity_match", "rank_match", "time_scope_match", "measure_match")
RELIABILITY_BANDS = ((0.75, "low"), (0.90, "moderate"))
MINIMUM_PER_SPLIT = 3


def format_answer(questions: DataFrame, rows: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """Result rows of each question as one answer text.

    A question's rows are one query result (a scalar or a top-k list), and the answer one
    text, so they meet in one row: results of some 100,000 rows a question are its bound.
    """
    kinds = dict(rows.dtypes)
    cells = [format_scalar(F.col(v), kinds[v]) for v in values]
    labelled = F.concat_ws(", ", *[F.concat(F.lit(f"{v}: "), cell) for v, cell in zip(values, cells)])
    alone = cells[0] if len(values) == 1 else labelled
    packed = rows.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), labelled.alias("line"), alone.alias("alone")))).alias("lines")
    )
    numbered = F.array_join(
        F.transform("lines", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["line"])), "\n"
    )
    text = (
        F.when(F.col("lines").isNull(), NO_RESULTS)
        .when(F.size("lines") == 1, F.col("lines")[0]["alone"])
        .otherwise(numbered)
    )
    return questions.select(key).join(packed, key, "left").select(key, text.alias("answer_text"))


def structured_truth(questions: DataFrame, rows: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """Result rows of each question as JSON with columns, rows and row count; bounded as in ``format_answer``."""
    record = F.struct(*values)
    packed = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), record.alias("r")))).alias("p"))
    names = F.array(*[F.lit(v) for v in values])
    found = F.col("p").isNotNull()
    truth = F.struct(
        F.when(found, names).otherwise(F.array().cast("array<string>")).alias("columns"),
        F.coalesce(F.transform("p", lambda x: x["r"]), F.array()).alias("rows"),
        F.when(found, F.size("p")).otherwise(0).alias("row_count"),
    )
    return questions.select(key).join(packed, key, "left").select(key, F.to_json(truth).alias("truth_json"))


def word_flag(value: Column, true_words: tuple[str, ...], false_words: tuple[str, ...]) -> Column:
    """True, false or NULL (not a known word)."""
    word = F.lower(F.trim(value))
    return F.when(word.isin(*true_words), True).when(word.isin(*false_words), False)


def deterministic_verdict(expected: Column, actual: Column, shape: Column) -> Column:
    """Struct of verdict, reason and source; NULL where a judge is needed. Each text is folded and read once."""

    def read(t: Column) -> Column:
        number = F.when(shape == "scalar", compare_folded(t["want"], t["got"]))
        return F.struct(normalized(t["want"]).alias("want"), normalized(t["got"]).alias("got"), number.alias("number"))

    def scored(verdict: str, reason: str) -> Column:
        return F.struct(
            F.lit(verdict).alias("verdict"), F.lit(f"heuristic_{reason}").alias("reason_code"), F.lit("heuristic").alias("score_source")
        )

    def judged(r: Column) -> Column:
        has_marker = F.lit(False)
        for marker in NO_RESULT_MARKERS:
            has_marker = has_marker | F.contains(r["got"], F.lit(marker))
        return (
            F.when(r["want"] == r["got"], scored("yes", "exact_match"))
            .when((r["want"] == "no results") & has_marker, scored("yes", "no_results_match"))
            .when(r["number"], scored("yes", "numeric_match"))
            .when(~r["number"], scored("no", "numeric_mismatch"))
        )

    return bound(bound(F.struct(fold(expected).alias("want"), fold(actual).alias("got")), read), judged)


def parse_judge_payload(raw: DataFrame, text: str) -> DataFrame:
    """Verdict, reason and match flags out of a judge's reply.

    The object runs from the first ``{`` to the last ``}``, whatever surrounds it.
    A missing verdict reads as "no", as its text form "None" starts with it; a
    reply without a JSON object has NULLs and ``parse_ok`` false.
    """
    body = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    fields = ", ".join(f"{name} string" for name in ("verdict", "reason_code", *MATCH_FIELDS, "notes"))
    parsed = raw.withColumn("_body", body).withColumn(
        "_p", F.when(F.try_parse_json("_body").isNotNull(), F.from_json("_body", fields))
    )
    answer = F.lower(F.trim(F.coalesce(F.col("_p.verdict"), F.lit("none"))))
    verdict = F.when(answer.startswith("yes"), "yes").when(answer.startswith("no"), "no").otherwise("unexpected")
    ok = F.col("_p").isNotNull()
    return parsed.select(
        *raw.columns,
        ok.alias("parse_ok"),
        F.when(ok, verdict).alias("verdict"),
        F.col("_p.reason_code").alias("reason_code"),
        *[word_flag(F.col(f"_p.{name}"), TRUE_WORDS, FALSE_WORDS).alias(name) for name in MATCH_FIELDS],
        F.col("_p.notes").alias("notes"),
    )


def calibration_metrics(cases: DataFrame) -> DataFrame:
    """Confusion counts and rates of ``judge_verdict`` against ``expected_verdict``."""
    truth, judged = F.col("expected_verdict"), F.col("judge_verdict")
    counts = cases.agg(
        F.count(F.lit(1)).alias("cases"),
        count_if((truth == "yes") & (judged == "yes")).alias("tp"),
        count_if((truth == "no") & (judged == "yes")).alias("fp"),
        count_if((truth == "yes") & (judged == "no")).alias("fn"),
        count_if((truth == "no") & (judged == "no")).alias("tn"),
        count_if(truth == judged).alias("correct"),
    )

    def rate(top: Column, bottom: Column) -> Column:
        return F.coalesce(ratio(top, bottom), F.lit(0.0))

    measured = counts.select(
        "cases", "tp", "fp", "fn", "tn",
        ratio(F.col("correct"), F.col("cases")).alias("judge_accuracy"),
        rate(F.col("tp"), F.col("tp") + F.col("fp")).alias("judge_precision"),
        rate(F.col("tp"), F.col("tp") + F.col("fn")).alias("judge_recall"),
        rate(F.col("fp"), F.col("tn") + F.col("fp")).alias("judge_fpr"),
    )
    precision, recall = F.col("judge_precision"), F.col("judge_recall")
    band = F.lit("high")
    for limit, name in reversed(RELIABILITY_BANDS):
        band = F.when(F.col("judge_accuracy") < limit, name).otherwise(band)
    return measured.select(
        "*",
        rate(2 * precision * recall, precision + recall).alias("judge_f1"),
        recall.alias("judge_tpr"),
        band.alias("reliability"),
    )


def calibration_by_group(cases: DataFrame, group: str) -> DataFrame:
    correct = F.col("expected_verdict") == F.col("judge_verdict")
    return cases.groupBy(group).agg(
        F.count(F.lit(1)).alias("cases"),
        ratio(count_if(correct), F.count(F.lit(1))).alias("accuracy"),
        count_if(~correct).alias("failures"),
    )


def rescore(answers: DataFrame, cases: DataFrame, judge: DataFrame) -> DataFrame:
    """One scored row per answer: heuristic verdict first, judge verdict as fallback."""
    merged = answers.join(cases, "question", "left").withColumn(
        "_h",
        deterministic_verdict(F.col("expected_answer_text"), F.col("actual_answer"), F.col("expected_shape")),
    )
    heuristic = F.col("_h").isNotNull()
    judged = judge.select("question", F.col("verdict").alias("_jv"), F.col("reason_code").alias("_jr"))
    verdict = F.coalesce(F.col("_h.verdict"), F.col("_jv"))
    sdk_pass = word_flag(F.col("sdk_result"), PASS_WORDS, FAIL_WORDS)
    robust_pass = F.coalesce(verdict == "yes", F.lit(False))
    return merged.join(judged, "question", "left").select(
        "question_id", "split", "slice", "question",
        sdk_pass.alias("sdk_pass"),
        verdict.alias("robust_verdict"),
        robust_pass.alias("robust_pass"),
        F.when(heuristic, "heuristic").otherwise("judge").alias("score_source"),
        F.when(heuristic, F.col("_h.reason_code")).otherwise(F.col("_jr")).alias("reason_code"),
        sdk_pass.eqNullSafe(robust_pass).alias("sdk_vs_robust_match"),
    )


def as_number(flag: str) -> Column:
    return F.col(flag).cast("int")


def corrected_rate(observed: Column, tpr: Column, fpr: Column) -> Column:
    """Pass rate freed of judge error, within [0, 1]; unchanged for a random judge."""
    raw = ratio(observed - fpr, tpr - fpr)
    return F.when(tpr - fpr > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))).otherwise(observed)


def adjusted_accuracy(scores: DataFrame, calibration: DataFrame) -> DataFrame:
    """Run summary; only judge-scored rows are corrected."""
    judged = F.col("score_source") == "judge"
    passed = F.col("robust_pass")
    totals = scores.agg(
        F.count(F.lit(1)).alias("total_questions"),
        count_if(F.coalesce("sdk_pass", F.lit(False))).alias("sdk"),
        count_if(passed).alias("robust"),
        count_if(judged).alias("judge_n"),
        count_if(judged & passed).alias("judge_passed"),
        count_if(~judged & passed).alias("heuristic_passed"),
        count_if(F.col("split") == "holdout").alias("holdout_n"),
        count_if((F.col("split") == "holdout") & passed).alias("holdout_passed"),
    )
    n = F.col("total_questions")
    # Both sides are one-row aggregates.
    joined = totals.join(F.broadcast(calibration)).withColumn(
        "rate",
        corrected_rate(F.coalesce(ratio(F.col("judge_passed"), F.col("judge_n")), F.lit(0.0)), F.col("judge_tpr"), F.col("judge_fpr")),
    )
    adjusted = F.coalesce(ratio(F.col("heuristic_passed") + F.col("rate") * F.col("judge_n"), n), F.lit(0.0))
    slack = F.coalesce(ratio((1 - F.col("judge_accuracy")) * F.col("judge_n"), n), F.lit(0.0))
    return joined.select(
        "total_questions",
        F.coalesce(ratio(F.col("sdk"), n), F.lit(0.0)).alias("sdk_accuracy"),
        F.coalesce(ratio(F.col("robust"), n), F.lit(0.0)).alias("robust_accuracy"),
        adjusted.alias("adjusted_accuracy"),
        F.greatest(F.lit(0.0), adjusted - slack).alias("adjusted_lower_bound"),
        F.least(F.lit(1.0), adjusted + slack).alias("adjusted_upper_bound"),
        "judge_accuracy",
        F.col("judge_n").alias("judge_scored_questions"),
        (n - F.col("judge_n")).alias("heuristic_scored_questions"),
        ratio(F.col("holdout_passed"), F.col("holdout_n")).alias("holdout_accuracy"),
    )


def adjusted_accuracy_simple(scores: DataFrame, calibration: DataFrame) -> DataFrame:
    """Correction of the overall pass rate; the margin is the judge's error rate."""
    totals = scores.agg(F.count(F.lit(1)).alias("total_questions"), count_if(F.coalesce("sdk_pass", F.lit(False))).alias("passed"))
    observed = F.coalesce(ratio(F.col("passed"), F.col("total_questions")), F.lit(0.0))
    adjusted = corrected_rate(observed, F.col("judge_tpr"), F.col("judge_fpr"))
    slack = 1 - F.col("judge_accuracy")
    return totals.join(F.broadcast(calibration)).select(
        "total_questions",
        "passed",
        (observed * 100).alias("raw_accuracy_percent"),
        adjusted.alias("adjusted_pass_rate"),
        F.greatest(F.lit(0.0), adjusted - slack).alias("lower_bound"),
        F.least(F.lit(1.0), adjusted + slack).alias("upper_bound"),
    )


def score_summary(scores: DataFrame, keys: list[str], disagreements: bool) -> DataFrame:
    """Accuracies per group; unknown SDK results stay out of the SDK mean."""
    n = F.count(F.lit(1))
    measures = [
        n.alias("questions"),
        ratio(F.sum(as_number("robust_pass")), n).alias("robust_accuracy"),
        ratio(F.sum(as_number("sdk_pass")), F.count("sdk_pass")).alias("sdk_accuracy"),
        ratio(count_if(F.col("score_source") == "heuristic"), n).alias("heuristic_share"),
    ]
    if disagreements:
        measures.append(count_if(~F.col("sdk_vs_robust_match")).alias("disagreements"))
    return scores.groupBy(*keys).agg(*measures)


def disagreements(scores: DataFrame) -> DataFrame:
    return scores.filter(~F.col("sdk_vs_robust_match"))


def question_summary(runs: DataFrame) -> DataFrame:
    """Outcomes of repeated runs: true, false, unclear, share true, failed threads.

    One row per failed thread, so that a question asked very often needs no list;
    a question without failures keeps one row. The two kinds of questions are
    joined and added apart, as an outer join could not be split for a hot one.
    """
    right = F.col("passed")
    counted = runs.groupBy("question").agg(
        count_if(right).alias("true_runs"),
        count_if(~right).alias("false_runs"),
        count_if(right.isNull()).alias("unclear_runs"),
        (ratio(count_if(right), F.count(F.lit(1))) * 100).alias("true_percent"),
    )
    failed = runs.filter(~right).select("question", F.col("thread").alias("failed_thread"))
    with_failures = counted.join(failed, "question")
    return with_failures.unionByName(counted.filter(F.col("false_runs") == 0), allowMissingColumns=True)


def split_size_check(cases: DataFrame, minimum: int = MINIMUM_PER_SPLIT) -> DataFrame:
    """Splits with fewer cases than the minimum."""
    sizes = cases.groupBy("split").agg(F.count(F.lit(1)).alias("cases"))
    return sizes.filter(F.col("cases") < minimum)


def fingerprint(records: DataFrame, columns: list[str]) -> DataFrame:
    """Content hash that does not depend on row order: sum of 64-bit row hashes and count.

    Fields carry their length, so neither separators nor missing values make rows alike.
    """

    def field(name: str) -> Column:
        value = F.col(name).cast("string")
        return F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    piece = F.conv(F.substring(F.sha2(F.concat(*[field(c) for c in columns]), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return records.agg(F.count(F.lit(1)).alias("records"), F.sum(piece).cast("string").alias("fingerprint"))

"""Answer evaluation over cases, answers and verdicts derived from the tables.

Every customer gives one case (its balance, its nation, a share or no result) and
one answer that is right, slightly off, far off or a refusal; labels give the
judge's calibration.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallybook.functions.numeric import money
from tallybook.functions.text import compare_numeric, number_tokens, normalize_text, read_number
from tallybook.operators import evaluation as ev
from tallybook.sources.tables import Tables

CASE_COLUMNS = ["question_id", "split", "slice", "expected_shape", "question", "expected_answer_text"]
GROUP_VALUES = ["segment", "customers"]


def pick(index: Column, *choices) -> Column:
    """The choice at ``index``, counted from zero."""
    chosen = None
    for n, choice in enumerate(choices):
        value = choice if isinstance(choice, Column) else F.lit(choice)
        chosen = F.when(index == n, value) if chosen is None else chosen.when(index == n, value)
    return chosen


def people(t: Tables) -> DataFrame:
    nation = F.broadcast(t["nation"].select("n_nationkey", "n_name"))
    return t["customer"].join(nation, F.col("c_nationkey") == F.col("n_nationkey"))


def question() -> Column:
    return F.concat(F.lit("What is known about "), F.col("c_name"), F.lit("?"))


def cases(t: Tables) -> DataFrame:
    key, kind = F.col("c_custkey"), F.col("c_custkey") % 6
    share = F.concat((key % 100).cast("string"), F.lit("%"))
    return people(t).select(
        F.concat(F.lit("q"), key.cast("string")).alias("question_id"),
        F.when(key % 3 == 0, "holdout").otherwise("dev").alias("split"),
        F.when(kind == 3, "single_entity").otherwise("scalar").alias("slice"),
        F.when(kind == 3, "single_entity").otherwise("scalar").alias("expected_shape"),
        question().alias("question"),
        pick(
            kind,
            money("c_acctbal").cast("string"),
            F.concat(F.lit("$"), F.format_number(money("c_acctbal"), 2)),
            ev.NO_RESULTS,
            F.col("n_name"),
            share,
            F.concat(F.lit("Recurring revenue is $"), (key % 9 + 1).cast("string"), F.lit(",400,000.")),
        ).alias("expected_answer_text"),
    )


def answers(t: Tables) -> DataFrame:
    key, kind, turn = F.col("c_custkey"), F.col("c_custkey") % 6, F.floor(F.col("c_custkey") / 6) % 4
    factor = pick(turn, "1.000", "1.005", "1.050", "1.000").cast("decimal(4,3)")
    near = (money("c_acctbal") * factor).cast("decimal(14,2)")
    said = pick(
        kind,
        F.concat(F.lit("The balance is "), near.cast("string"), F.lit(" in total")),
        F.concat(F.lit("It comes to $"), F.format_number(near, 2), F.lit(".")),
        pick(turn, "No matching records were found.", "no  résults", "There are 7 of them.", "Nothing."),
        pick(turn, F.lower("n_name"), F.concat(F.lit("The nation is "), F.col("n_name")), "NATION_0", "I do not know"),
        pick(
            turn,
            F.concat(F.lit("The rate is "), F.format_string("%.2f", (key % 100) / 100.0)),
            F.concat((key % 100).cast("string"), F.lit(" % of all")),
            F.concat(F.lit("about "), ((key + 7) % 100).cast("string"), F.lit("%")),
            "between 3 and 400",
        ),
        pick(
            turn,
            F.concat(F.lit("MRR is $"), (key % 9 + 1).cast("string"), F.lit(".4M.")),
            F.concat(F.lit("MRR is "), (key % 9 + 1).cast("string"), F.lit(".4 million")),
            "MRR is 3.1k",
            "MRR is $1.4M and retention is 71%",
        ),
    )
    result = pick(key % 5, "pass", "Failed", "TRUE", "n/a", "incorrect")
    refused = (turn == 3) & (kind < 2)
    return people(t).select(
        question().alias("question"),
        F.when(refused, "I was unable to find data.").otherwise(said).alias("actual_answer"),
        result.alias("sdk_result"),
    )


def replies(t: Tables) -> DataFrame:
    """Raw judge replies per customer question: fenced, wrapped, partial or broken JSON."""
    key = F.col("c_custkey")
    verdict = pick(key % 4, "yes", "No, wrong entity", " YES ", "maybe")
    full = F.concat(
        F.lit('{"verdict": "'), verdict, F.lit('", "reason_code": "r'), (key % 3).cast("string"),
        F.lit('", "numeric_match": true, "entity_match": "no", "rank_match": 1, "time_scope_match": null, "measure_match": "n/a", "notes": "n {'),
        key.cast("string"), F.lit('}"}'),
    )
    raw = pick(
        key % 7,
        full,
        F.concat(F.lit("```json\n"), full, F.lit("\n```")),
        F.concat(F.lit("Sure, here it is: "), full, F.lit(" Hope this helps.")),
        F.lit('{"reason_code": "none_given"}'),
        F.concat(F.lit("{broken "), full),
        F.lit("I cannot judge this."),
        F.concat(F.lit("\n\n"), full),
    )
    return t["customer"].select(question().alias("question"), raw.alias("raw_response"))


def calibration_cases(t: Tables) -> DataFrame:
    """Labelled documents: quality is the truth, a toxicity label the judge's verdict."""
    judged = F.when(F.col("doc_id") % 17 == 0, "unexpected").when(F.col("toxic") == 0, "yes").otherwise("no")
    return t["labels"].select(
        "doc_id",
        F.when(F.col("quality") == 1, "yes").otherwise("no").alias("expected_verdict"),
        judged.alias("judge_verdict"),
    )


def scores(t: Tables) -> DataFrame:
    return ev.rescore(answers(t), cases(t), ev.parse_judge_payload(replies(t), "raw_response"))


def result_rows(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Questions "customers by segment" per nation, some empty, and their result rows."""
    questions = t["nation"].select(F.col("n_name").alias("question_id"))
    counted = people(t).groupBy("n_name", "n_nationkey", F.col("c_mktsegment").alias("segment")).agg(
        F.count(F.lit(1)).alias("customers"), F.sum(money("c_acctbal")).cast("double").alias("balance")
    )
    order = W.partitionBy("n_name").orderBy(F.desc("customers"), "segment")
    kept = pick(F.col("n_nationkey") % 3, 0, 1, 5)
    ranked = counted.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= kept)
    return questions, ranked.withColumnRenamed("n_name", "question_id")


def ev_format_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions, rows = result_rows(Tables(spark, sf_dir))
    return ev.format_answer(questions, rows, "question_id", "place", ["segment", "customers", "balance"])


def ev_structured_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions, rows = result_rows(Tables(spark, sf_dir))
    return ev.structured_truth(questions, rows, "question_id", "place", GROUP_VALUES)


def ev_normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir)["documents"].select("doc_id", normalize_text("text").alias("normalized"))


def ev_extract_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number of every document with its position."""
    docs = Tables(spark, sf_dir)["documents"]
    tokens = docs.select("doc_id", F.posexplode(number_tokens("text")).alias("position", "token"))
    value = read_number(F.col("token"))
    return tokens.select(
        "doc_id", "position", "token", value.alias("value"), F.when(F.col("token").endswith("%"), value / 100.0).alias("fraction")
    )


def ev_compare_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    both = cases(t).join(answers(t), "question")
    return both.select("question_id", compare_numeric("expected_answer_text", "actual_answer").alias("numeric_match"))


def ev_deterministic_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    verdict = ev.deterministic_verdict(F.col("expected_answer_text"), F.col("actual_answer"), F.col("expected_shape"))
    return cases(t).join(answers(t), "question").select("question_id", verdict.alias("v")).select("question_id", "v.*")


def ev_parse_judge_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.parse_judge_payload(replies(Tables(spark, sf_dir)), "raw_response").drop("raw_response")


def ev_calibration_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.calibration_metrics(calibration_cases(Tables(spark, sf_dir)))


def ev_calibration_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    grouped = calibration_cases(t).join(t["documents"].select("doc_id", F.col("lang").alias("case_group")), "doc_id")
    return ev.calibration_by_group(grouped, "case_group")


def ev_rescore_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(Tables(spark, sf_dir))


def ev_adjusted_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return ev.adjusted_accuracy(scores(t), ev.calibration_metrics(calibration_cases(t)))


def ev_adjusted_accuracy_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    sdk = answers(t).select(ev.word_flag(F.col("sdk_result"), ev.TRUE_WORDS, ()).alias("sdk_pass"))
    return ev.adjusted_accuracy_simple(sdk, ev.calibration_metrics(calibration_cases(t)))


def ev_split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.score_summary(scores(Tables(spark, sf_dir)), ["split"], disagreements=True)


def ev_slice_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.score_summary(scores(Tables(spark, sf_dir)), ["split", "slice"], disagreements=False)


def ev_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.disagreements(scores(Tables(spark, sf_dir)))


def ev_question_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as questions, their events as repeated runs."""
    kind = F.col("event_type")
    passed = F.when(kind.isin("click", "purchase"), True).when(kind == "error", False)
    runs = Tables(spark, sf_dir)["events"].select(
        F.col("user_id").alias("question"), F.col("event_id").alias("thread"), passed.alias("passed")
    )
    return ev.question_summary(runs)


def ev_split_size_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source and language of documents as splits."""
    docs = Tables(spark, sf_dir)["documents"].select(F.concat_ws("/", "lang", "source").alias("split"))
    return ev.split_size_check(docs, minimum=30)


def ev_dataset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.fingerprint(cases(Tables(spark, sf_dir)), CASE_COLUMNS)


SUITE = {
    f.__name__: f
    for f in (
        ev_format_answer, ev_structured_truth, ev_normalize_text, ev_extract_numbers, ev_compare_numeric,
        ev_deterministic_verdict, ev_parse_judge_payload, ev_calibration_metrics, ev_calibration_by_group,
        ev_rescore_merge, ev_adjusted_accuracy, ev_adjusted_accuracy_simple, ev_split_summary, ev_slice_summary,
        ev_disagreements, ev_question_summary, ev_split_size_check, ev_dataset_fingerprint,
    )
}

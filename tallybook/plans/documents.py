"""JSON and document jobs over customers, documents, conversations and pages."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions.numeric import money
from tallybook.operators import documents as docs
from tallybook.operators import pages as pg
from tallybook.operators.stages import ChatMessages
from tallybook.sources.tables import Tables

KEYWORD = "the"
INSTRUCTION = "List the product updates in this text as JSON."
STATUSES = ["New", "Update"]


def text(value: Column) -> Column:
    return value.cast("string")


def joined(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt over all tasks: a file of few row groups, read as it is, would keep most of them idle."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


def document_pairs(t: Tables) -> DataFrame:
    """Nested JSON per customer and a prediction with known kinds of errors."""
    key, name = F.col("c_custkey"), F.col("c_name")
    balance = text(money("c_acctbal"))
    segment = joined('"', F.col("c_mktsegment"), '"')
    nation = text(F.col("c_nationkey"))
    scores = joined("[", text(key % 5), ", ", text(key % 3), ", 7]")
    tags = joined('[{"t": "a", "n": ', text(key % 2), '}, {"t": "b", "n": null}]')
    profile = joined('{"segment": ', segment, ', "place": {"nation": ', nation, ', "home": true}}')

    def document(bal: Column, prof: Column, marks: Column, more: Column | str) -> Column:
        return joined('{"name": "', name, '", "balance": ', bal, ', "profile": ', prof, ', "scores": ', marks, ', "tags": ', tags, more, "}")

    actual = document(balance, profile, scores, ', "meta__old": 1, "empty": {}')
    wrong = [
        actual,
        document(text(money("c_acctbal") + 1), profile, scores, ', "meta__old": 1, "empty": {}, "extra": "x"'),
        document(balance, joined('{"segment": ', segment, "}"), scores, ', "meta__old": 2, "empty": {}'),
        document(balance, profile, joined("[9, ", text(key % 3), "]"), ', "meta__old": 1, "empty": {"now": 5}'),
        document(balance, segment, scores, ', "meta__old": 1, "empty": []'),
        document(balance, profile, scores, ', "empty": {}, "top__x": 5, "more": {"a": 1, "b__old": 2, "c": [1, {"d": "e"}]}'),
        F.lit("{}"),
    ]
    predicted = F.lit(None).cast("string")
    for n, candidate in enumerate(wrong):
        predicted = F.when(key % 7 == n, candidate).otherwise(predicted)
    people = dealt(t["customer"].select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", "c_nationkey"))
    return people.select(key.alias("doc_id"), actual.alias("actual"), predicted.alias("predicted"))


def js_field_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs.field_count(document_pairs(Tables(spark, sf_dir)), "doc_id", "predicted")


def js_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs.json_diff(document_pairs(Tables(spark, sf_dir)), "doc_id", "actual", "predicted")


def js_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs.json_accuracy(document_pairs(Tables(spark, sf_dir)), "doc_id", "actual", "predicted")


def js_list_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines as a list beside an edited one, compared by position and by alignment.

    The edits: none, a line put in front, the first one gone, the last one moved to the front,
    the second one changed with one appended.
    """
    lines, first = F.split("text", "\n"), F.array(F.lit("put in front"))
    last = F.slice(lines, -1, 1)
    changed = F.transform(lines, lambda line, at: F.when(at == 1, F.concat(F.lit("* "), line)).otherwise(line))
    edits = [lines, F.concat(first, lines), F.slice(lines, 2, F.size(lines)), F.concat(last, F.slice(lines, 1, F.size(lines) - 1)), F.concat(changed, F.array(F.lit("appended")))]
    edited = F.element_at(F.array(*edits), (F.col("doc_id") % len(edits) + 1).cast("int"))

    def body(items: Column) -> Column:
        return F.to_json(F.struct(F.col("doc_id").alias("id"), items.alias("lines")))

    pairs = Tables(spark, sf_dir)["documents"].where(F.col("text").isNotNull()).select("doc_id", body(lines).alias("actual"), body(edited).alias("predicted"))
    return docs.json_accuracy(pairs, "doc_id", "actual", "predicted", ("position", "aligned"))


def updates(t: Tables) -> DataFrame:
    """Each document's lines as the updates of one JSON publication."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int"))

    def update(line: Column, at: Column) -> Column:
        return F.struct(
            F.col("lang").alias("workload"),
            F.col("source").alias("item"),
            joined("f", text(at)).alias("feature"),
            line.alias("description"),
            F.when(at % 2 == 0, "New").when(at % 7 == 5, "Retired").otherwise("Update").alias("status"),
            F.slice(F.split(line, " "), 1, 3).alias("tasks"),
        )

    publication = F.struct(text(day).alias("publicationDate"), F.transform(F.split("text", "\n"), update).alias("updates"))
    stored = t["documents"].select("doc_id", F.to_json(publication).alias("body"))
    return stored.select("doc_id", F.from_json("body", docs.UPDATES_SCHEMA).alias("p")).select("doc_id", "p.*")


def js_flatten_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = docs.flatten_updates(updates(Tables(spark, sf_dir)), ["doc_id"])
    return flat.withColumn("tasks", F.array_join("tasks", "|"))


def js_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = docs.flatten_updates(updates(Tables(spark, sf_dir)))
    return docs.crosstab(flat, "workload", "status", STATUSES).withColumnsRenamed({"New": "new_updates", "Update": "changed_updates", "other": "other_updates"})


def js_flatten_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    creator = F.when(key % 5 != 0, joined('{"displayName": "Creator ', text(key % 11), '", "id": "u', text(key % 11), '"}')).otherwise("null")
    last = F.when(key % 3 == 0, joined(', "lastUpdatedDate": "2024-01-', F.lpad(text(key % 28 + 1), 2, "0"), '"')).otherwise("")
    body = joined(
        '{"id": "', text(key), '", "type": "', F.col("c_mktsegment"), '", "name": "', F.col("c_name"),
        '", "state": "Active", "creatorPrincipal": ', creator, ', "workspaceId": "w', text(F.col("c_nationkey")), '"', last, "}",
    )
    items = Tables(spark, sf_dir)["customer"].select(body.alias("body"))
    return docs.flatten_items(items, "body")


def js_chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per message of each request."""
    stage = ChatMessages(inputCol="text", outputCol="messages", instruction=INSTRUCTION)
    requests = PipelineModel([stage]).transform(Tables(spark, sf_dir)["documents"].select("doc_id", "text"))
    return requests.select("doc_id", F.posexplode("messages").alias("place", "m")).select("doc_id", "place", "m.*")


def js_completion_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = joined('{\n"role":\n"', F.col("role"), '",\n"chars": ', text(F.length("text")), "\n}")
    choice = F.struct(F.struct(content.alias("content")).alias("message"))
    completions = F.struct(F.array(choice).alias("choices"))
    parsed = docs.completion_content(completions, "role string, chars int")
    turns = Tables(spark, sf_dir)["conversations"]
    return turns.select("conv_id", "turn", parsed.alias("c")).select("conv_id", "turn", "c.*")


def doc_keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notebooks: every other line is a code cell."""
    cells = F.transform(
        F.split("text", "\n"),
        lambda line, at: F.struct(F.when(at % 2 == 0, "code").otherwise("markdown").alias("cell_type"), line.alias("source")),
    )
    stored = Tables(spark, sf_dir)["documents"].select("doc_id", "source", cells.alias("cells"))
    return stored.filter(docs.has_code_with("cells", KEYWORD)).select("doc_id", "source")


#: Elements that pages have, as the fields of a card.
PAGE_FIELDS = {
    "product_name": pg.text_of("title"),
    "idea": pg.text_of("h1"),
    "date": pg.attribute_of("", "lang"),
    "state": pg.attribute_of("meta[charset]", "charset"),
    "user_id": pg.text_of("footer"),
    "like_count": pg.comment_of(),
    "description": pg.text_of("div.ad"),
}


def doc_html_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as one card; its fields are elements that pages have."""
    pages = Tables(spark, sf_dir)["pages"].select("page_id", "html")
    fields = PAGE_FIELDS | {"votes": pg.text_of("li"), "idea_id": pg.attribute_of("a[href]", "href", "/", "=")}
    return pg.select_cards(pages, ["page_id"], "html", "html", fields)


def doc_html_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every list entry of each page as a card, with the page's own fields on each of them."""
    pages = Tables(spark, sf_dir)["pages"].select("page_id", "html")
    own = {"votes": pg.text_of(""), "idea_id": pg.attribute_of("a[href]", "href", "/", "=")}
    return pg.select_cards(pages, ["page_id"], "html", "li", own, PAGE_FIELDS)


def doc_regex_connection(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    call = joined('let Source = Sql.Database("srv-', text(F.col("c_nationkey")), '.example.com", "db_', F.lower("c_mktsegment"), '") in Source')
    expression = F.when(key % 4 == 0, 'let Source = Csv.Document("a", "b")').otherwise(call)
    return Tables(spark, sf_dir)["customer"].select(key.alias("expression_id"), *docs.connection_parts(expression))


SUITE = {
    f.__name__: f
    for f in (
        js_field_count, js_diff, js_accuracy, js_list_diff, js_flatten_updates, js_crosstab, js_flatten_items, js_chat_messages,
        js_completion_content, doc_keyword_search, doc_html_cards, doc_html_entries,
        doc_regex_connection,
    )
}

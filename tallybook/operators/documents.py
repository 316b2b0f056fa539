"""JSON accuracy, flattening of nested documents, text and page extraction."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions import json_tree as jt
from tallybook.functions.json_align import differences, fields, parsed
from tallybook.functions.numeric import ratio
from tallybook.functions.text import strip_space

# Nested record layouts and patterns of the documents.
UPDATES_SCHEMA = (
    "publicationDate string, updates array<struct<workload string, item string, feature string, "
    "description string, status string, tasks array<string>>>"
)
ITEM_SCHEMA = (
    "id string, type string, name string, state string, creatorPrincipal struct<displayName string, id string>, "
    "workspaceId string, capacityId string, lastUpdatedDate string"
)
CELLS_SCHEMA = "cells array<struct<cell_type string, source string>>"
CARD_FIELDS = ("product_name", "idea_id", "idea", "votes", "date", "state", "user_id", "like_count", "description")
#: Common named references; the ampersand comes last, so that it makes no new ones.
ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\xa0", "middot": "\xb7", "copy": "\xa9", "reg": "\xae", "trade": "\u2122",
    "hellip": "\u2026", "ndash": "\u2013", "mdash": "\u2014", "lsquo": "\u2018", "rsquo": "\u2019", "ldquo": "\u201c", "rdquo": "\u201d",
    "euro": "\u20ac", "laquo": "\xab", "raquo": "\xbb", "bull": "\u2022",
}
CONNECTION = r'Sql\.Database\("(.*?)", "(.*?)"\)'


def field_count(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Primitive fields per JSON document."""
    return df.select(id_col, jt.field_count(jt.json_nodes(F.col(json_col))).alias("total_fields"))


def json_diff(df: DataFrame, id_col: str, actual_col: str, predicted_col: str, lists: str | Sequence[str] = "position") -> DataFrame:
    """Fields, additions, deletions and modifications per pair of documents; NULL where a text is malformed.

    Lists are compared by ``position``, where an element put in front changes all that follow,
    or ``aligned``: equal elements of a longest common subsequence stay, of the others between
    them as many as possible are taken for replaced, and those are compared in turn. Several
    ways give a row each, with a column ``mode``.
    """
    modes = [lists] if isinstance(lists, str) else list(lists)

    def compared(actuals: pa.Array, predictions: pa.Array) -> pa.Array:
        rows = []
        for actual, predicted in zip(actuals, predictions):
            own, other = actual.as_py(), predicted.as_py()
            a_known, a = parsed(own)
            p_known, p = (a_known, a) if own == other else parsed(other)
            total = fields(a) if a_known else None
            for mode in modes:
                counts = (0, 0, 0) if a_known and a is p else differences(a, p, mode) if a_known and p_known else (None, None, None)
                rows.append((mode, total, *counts))
        columns = list(zip(*rows)) or [()] * 5
        kinds = [pa.string(), *[pa.int32()] * 4]
        names = ["mode", "total_fields", "additions", "deletions", "modifications"]
        each = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
        return pa.ListArray.from_arrays(pa.array(range(0, len(rows) + 1, len(modes)), pa.int32()), each)

    counts = "mode string, total_fields int, additions int, deletions int, modifications int"
    found = F.arrow_udf(compared, f"array<struct<{counts.replace(' ', ':').replace(',:', ',')}>>")(actual_col, predicted_col)
    rows = df.select(id_col, F.inline(found))
    return rows.drop("mode") if isinstance(lists, str) else rows


def json_accuracy(df: DataFrame, id_col: str, actual_col: str, predicted_col: str, lists: str | Sequence[str] = "position") -> DataFrame:
    """One minus differences per field, at least zero; 1.0 when there are no fields."""
    total = F.col("additions") + F.col("deletions") + F.col("modifications")
    share = F.coalesce(ratio(total, F.col("total_fields")), F.lit(0.0))
    score = F.when(total.isNotNull(), F.round(F.greatest(F.lit(0.0), 1 - share), 4))
    return json_diff(df, id_col, actual_col, predicted_col, lists).select("*", total.alias("total"), score.alias("score"))


def read_updates(spark: SparkSession, path: str) -> DataFrame:
    """Multi-line JSON files with nested updates; single quotes are accepted."""
    return spark.read.schema(UPDATES_SCHEMA).option("multiLine", True).json(path)


def flatten_updates(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per update, with the date of its document."""
    keep = keep or []
    return df.select(*keep, "publicationDate", F.explode("updates").alias("u")).select(*keep, "publicationDate", "u.*")


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of row values by column values, zero where none; all further values count as ``other``."""
    named = F.when(F.col(column).isin(values), F.col(column)).otherwise("other")
    return df.withColumn(column, named).groupBy(row).pivot(column, [*values, "other"]).count().fillna(0)


def flatten_items(df: DataFrame, json_col: str) -> DataFrame:
    """Nested item JSON as nine flat columns; missing parts are NULL."""
    item = df.select(F.from_json(json_col, ITEM_SCHEMA).alias("i"))
    return item.select(
        "i.id", "i.type", "i.name", "i.state",
        F.col("i.creatorPrincipal.displayName").alias("display_name"),
        F.col("i.creatorPrincipal.id").alias("creator_id"),
        F.col("i.workspaceId").alias("workspace_id"),
        F.col("i.capacityId").alias("capacity_id"),
        F.col("i.lastUpdatedDate").alias("last_updated_date"),
    )


def chat_messages(text_col: str, instruction: str) -> Column:
    """System and user message of one request."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), F.lit(role).alias("name"), content.alias("content"))

    return F.array(message("system", F.lit(instruction)), message("user", F.col(text_col)))


def completion_content(completions: Column, schema: str) -> Column:
    """Parsed JSON of the first choice; line breaks are removed first."""
    content = completions["choices"][0]["message"]["content"]
    return F.from_json(F.regexp_replace(content, "\n", ""), schema)


def has_code_with(cells: Column | str, keyword: str) -> Column:
    """Whether any code cell contains the keyword."""
    return F.exists(cells, lambda c: (c["cell_type"] == "code") & F.contains(c["source"], F.lit(keyword)))


def keyword_files(spark: SparkSession, directory: str, keyword: str, glob: str = "*.ipynb") -> DataFrame:
    """Notebook files under a directory with the keyword in a code cell.

    Unreadable files have no cells and drop out. The source of a cell is read as
    text, so a list of lines is searched in its JSON form.
    """
    files = (
        spark.read.schema(CELLS_SCHEMA)
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .json(directory)
    )
    wanted = files.filter(F.coalesce(has_code_with("cells", keyword), F.lit(False)))
    return wanted.select(F.col("_metadata.file_path").alias("path"))


def connection_parts(text: Column | str) -> list[Column]:
    """Server and database of a connection expression; NULL when there is none."""
    return [
        F.nullif(F.regexp_extract(text, CONNECTION, n), F.lit("")).alias(name) for n, name in ((1, "server"), (2, "database"))
    ]


def visible_text(markup: Column) -> Column:
    """Text of a piece of markup with its character references decoded, NULL when nothing is left."""
    plain = F.regexp_replace(markup, "<[^>]*>", "")
    decoded = plain
    for entity, sign in ENTITIES.items():
        decoded = F.replace(decoded, F.lit(f"&{entity};"), F.lit(sign))
    parts = F.regexp_extract_all(decoded, F.lit(r"(?s)&#[xX]?[0-9a-fA-F]{1,6};|.[^&]*|&"), F.lit(0))

    def character(part: Column) -> Column:
        hexadecimal = F.conv(F.regexp_extract(part, "^&#[xX]([0-9a-fA-F]+);$", 1), 16, 10)
        number = F.coalesce(F.nullif(F.regexp_extract(part, "^&#([0-9]+);$", 1), F.lit("")), F.nullif(hexadecimal, F.lit("0"))).try_cast("int")
        wide = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        return F.when(number.isNotNull() & (number < 0x110000), wide).otherwise(part)

    numeric = F.when(decoded.contains("&#"), F.array_join(F.transform(parts, character), "")).otherwise(decoded)
    return strip_space(F.replace(numeric, F.lit("&amp;"), F.lit("&")))


def captured(markup: Column, pattern: str) -> Column:
    """First group of the first match, NULL without a match."""
    return F.get(F.regexp_extract_all(markup, F.lit(pattern), F.lit(1)), F.lit(0))


def html_cards(pages: DataFrame, keep: list[str], html_col: str, card: str, texts: dict[str, str], ids: dict[str, tuple[str, str]], page_texts: dict[str, str] | None = None) -> DataFrame:
    """Repeated cards of a page as rows.

    ``card`` matches one card; ``texts`` maps a column to the pattern of its
    element, ``ids`` to the pattern of a link and the signs its id follows, cut off
    one after the other; ``page_texts`` maps a column to the pattern of an element of the
    whole page, read once and repeated on each of its cards. Fields without a pattern are NULL.
    """
    page = {name: visible_text(captured(F.col(html_col), pattern)).alias(f"_page_{name}") for name, pattern in (page_texts or {}).items()}
    cards = pages.select(*keep, *page.values(), F.posexplode(F.regexp_extract_all(html_col, F.lit(card), F.lit(1))).alias("card_number", "card"))

    def field(name: str) -> Column:
        if name in texts:
            return visible_text(captured(F.col("card"), texts[name])).alias(name)
        if name in ids:
            link, signs = ids[name]
            found = captured(F.col("card"), link)
            for sign in signs:
                found = F.substring_index(found, sign, -1)
            return found.alias(name)
        if name in page:
            return F.col(f"_page_{name}").alias(name)
        return F.lit(None).cast("string").alias(name)

    return cards.select(*keep, "card_number", *[field(name) for name in CARD_FIELDS])

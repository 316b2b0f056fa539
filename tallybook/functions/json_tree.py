"""JSON documents of unknown shape as arrays of nodes, inside the row.

A document's nodes stay in its own row, so counting needs neither a
shuffle nor a join, however uneven the documents are spread.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METADATA_MARK = "__"
OBJECT, ARRAY, LEAF = "object", "array", "leaf"
NODE = "struct<path: string, kind: string, hidden_below: array<string>, v: variant>"


def safe_key(key: Column) -> Column:
    """Key with the path signs escaped, so that paths stay unambiguous."""
    escaped = F.replace(key, F.lit("~"), F.lit("~0"))
    return F.replace(F.replace(escaped, F.lit("/"), F.lit("~1")), F.lit("["), F.lit("~2"))


def node(path: Column, marks: Column, v: Column) -> Column:
    is_object = F.try_variant_get(v, "$", "map<string,variant>").isNotNull()
    is_array = F.try_variant_get(v, "$", "array<variant>").isNotNull()
    kind = F.when(is_object, OBJECT).when(is_array, ARRAY).otherwise(LEAF)
    return F.struct(path.alias("path"), kind.alias("kind"), marks.alias("hidden_below"), v.alias("v"))


def children(parent: Column) -> Column:
    """Nodes one level below a container; none below a leaf."""
    members = F.map_entries(F.try_variant_get(parent["v"], "$", "map<string,variant>"))
    items = F.try_variant_get(parent["v"], "$", "array<variant>")

    def member(entry: Column) -> Column:
        marked = F.contains(entry["key"], F.lit(METADATA_MARK))
        marks = F.when(marked, F.array_append(parent["hidden_below"], parent["path"])).otherwise(parent["hidden_below"])
        return node(F.concat(parent["path"], F.lit("/"), safe_key(entry["key"])), marks, entry["value"])

    def item(value: Column, at: Column) -> Column:
        path = F.concat(parent["path"], F.lit("["), at.cast("string"), F.lit("]"))
        return node(path, parent["hidden_below"], value)

    below = F.when(parent["kind"] == OBJECT, F.transform(members, member)).when(parent["kind"] == ARRAY, F.transform(items, item))
    return F.coalesce(below, F.array().cast(f"array<{NODE}>"))


def json_nodes(json_text: Column) -> Column:
    """All nodes of a document, outermost first; NULL for malformed text.

    Each step expands the containers found by the step before; a document cannot
    be nested deeper than it has opening brackets.
    """
    no_marks = F.array().cast("array<string>")
    parsed = F.filter(F.array(F.try_parse_json(json_text)), lambda v: v.isNotNull())
    roots = F.transform(parsed, lambda v: node(F.lit(""), no_marks, v))
    begin = F.transform(F.array(roots), lambda r: F.struct(r.alias("seen"), r.alias("open")))[0]
    brackets = F.length(json_text) - F.length(F.translate(json_text, "{[", ""))
    steps = F.sequence(F.lit(1), brackets + 1)

    def expand(acc: Column) -> Column:
        return F.flatten(F.transform(F.filter(acc["open"], lambda n: n["kind"] != LEAF), children))

    def deeper(acc: Column, _: Column) -> Column:
        fresh = F.transform(
            F.array(expand(acc)), lambda found: F.struct(F.concat(acc["seen"], found).alias("seen"), found.alias("open"))
        )
        return F.when(F.size(acc["open"]) == 0, acc).otherwise(fresh[0])

    return F.aggregate(steps, begin, deeper, lambda acc: F.when(F.size(acc["seen"]) > 0, acc["seen"]))


def is_leaf(n: Column) -> Column:
    return n["kind"] == LEAF


def field_count(nodes: Column) -> Column:
    """Primitive leaves of a container; keys marked as metadata do not count."""
    counted = F.filter(nodes, lambda n: is_leaf(n) & (n["path"] != "") & (F.size(n["hidden_below"]) == 0))
    return F.size(counted)

"""A manifest of a table as Merkle trees, one per group, and every row's proof.

Nodes have a place in their tree. The digits of the place (base ``width``) are key columns;
within a block of width ** depth nodes they are grouped away one by one, lowest first, and
each step nests the children, in order, with the digest over them. The blocks' digests are
the nodes of the same job one storey up, until a tree is one block; what lies above a tree
(the other trees) is asked of ``roof``. Going back down, ``explode`` unnests the children
and ``transform`` notes what stands before and after each: the steps of its proof. A block is
the largest value built, whatever the size of a tree; blocks, not rows, meet what lies
above them in a join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.common import written
from tallybook.llm.ranks import ranked

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEPS = "array<struct<before:string,after:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def field(value: Column) -> Column:
    """``-`` for null, else the byte count, a colon and the value."""
    body = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(body).cast("string"), F.lit(":"), body))


def leaf_of(values: Sequence[Column]) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


def joined(nodes: Column) -> Column:
    return F.array_join(nodes, "")


def nested(nodes: DataFrame, payload: list[str], width: int, depth: int) -> DataFrame:
    """Blocks (tree, block, total, node, kids) of the nodes (tree, at, total, node, payload).

    A step hashes only where its tree has several nodes left: total > width ** (step - 1).
    """
    digits = [F.expr(f"(at div {width**k}) % {width}").cast("int").alias(f"d{k}") for k in range(depth)]
    rows = nodes.select("tree", F.expr(f"at div {width**depth}").alias("block"), "total", *digits, "node", *payload)
    rows = rows.repartition("tree", "block")  # all steps group by more than this, so none shuffles again
    inner = payload
    for step in range(depth):
        keys = ["tree", "block", "total", *[f"d{k}" for k in range(depth - 1, step, -1)]]
        rows = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(f"d{step}").alias("digit"), "node", *inner))).alias("kids"))
        several = F.col("total") > width**step
        rows = rows.withColumn("node", F.when(several, digest(joined(F.col("kids.node")))).otherwise(F.col("kids")[0]["node"]))
        inner = ["kids"]
    return rows


def unnested(blocks: DataFrame, payload: list[str], width: int, depth: int) -> DataFrame:
    """tree, at, node, payload, path, subroot and root of each node; the blocks have the path above them."""
    rows = blocks.withColumn("at", F.col("block"))
    for step in range(depth - 1, -1, -1):

        def with_step(kid: Column, i: Column) -> Column:
            nodes = F.col("kids.node")
            return F.struct(kid.alias("kid"), joined(F.slice(nodes, 1, i)).alias("before"), joined(F.slice(nodes, i + 2, width)).alias("after"))

        rows = rows.withColumn("one", F.explode(F.transform("kids", with_step)))
        own = F.array(F.struct("one.before", "one.after")).cast(STEPS)
        path = F.when(F.col("total") > width**step, F.concat(own, F.col("path"))).otherwise(F.col("path"))
        below = [F.col("one.kid.kids").alias("kids")] if step else [F.col(f"one.kid.{c}").alias(c) for c in payload]
        rows = rows.select(
            "tree", "total", "subroot", "root", path.alias("path"), (F.col("at") * width + F.col("one.kid.digit")).alias("at"), F.col("one.kid.node").alias("node"), *below
        )
    return rows.drop("total")


def climbed(nodes: DataFrame, payload: list[str], roof: Callable[[DataFrame], DataFrame], width: int, depth: int) -> DataFrame:
    """The nodes (tree, at, total, node, payload) with path, subroot (their tree's) and root.

    ``roof`` gets (tree, node), a row per tree, and adds what lies above: tree, path, root.
    """
    blocks = written(nested(nodes, payload, width, depth), "blocks")
    if blocks.where(F.col("total") > width**depth).isEmpty():
        above = roof(blocks.select("tree", "node"))
        whole = blocks.withColumnRenamed("node", "subroot").join(above, "tree")
    else:
        storey = blocks.select("tree", F.col("block").alias("at"), F.expr(f"(total + {width**depth - 1}) div {width**depth}").alias("total"), "node")
        above = climbed(storey, [], roof, width, depth).select("tree", F.col("at").alias("block"), "path", "subroot", "root")
        whole = blocks.drop("node").join(above, ["tree", "block"])
    return unnested(whole, payload, width, depth)


def of_trees(tops: DataFrame, width: int, depth: int) -> DataFrame:
    """tree, path and root above the trees (tree, node), which are themselves the nodes of one tree."""
    tops = tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node")
    counted = tops.withColumn("at", F.row_number().over(Window.orderBy("name")).cast("long") - 1).withColumn("total", F.count("*").over(Window.partitionBy()))
    top = lambda one: one.select("tree", F.array().cast(STEPS).alias("path"), F.col("node").alias("root"))
    return climbed(counted, ["name"], top, width, depth).select(F.col("name").alias("tree"), "path", "root")


def manifest(docs: DataFrame, changed: dict[str, Column] | None = None, where: Column | None = None, fields: Sequence[str] = FIELDS, tree_col: str = "lang", id_col: str = "doc_id", width: int = 8, depth: int = 3) -> DataFrame:
    """doc_id, leaf, subroot, root, path (bottom up: what stands before and after the row's node) and given_leaf.

    ``given_leaf`` is the leaf of the row as handed over for checking: with the values of
    ``changed`` on rows that meet ``where``, else the leaf. Leaves stand in the order of the id,
    null first, within their tree; equal ids in that of their leaves, and equal rows
    in any, which gives the same digests. Null is a tree of its own, the first one.
    No rows give no rows; columns other than ``fields`` are not read.
    """
    values = {c: F.col(f"`{c}`") for c in fields}
    leaf = leaf_of(list(values.values()))
    given = leaf_of([(changed or {}).get(c, v) for c, v in values.items()])
    tree = F.coalesce(F.concat(F.lit("="), values[tree_col].cast("string")), F.lit(""))
    rows = docs.select(tree.alias("tree"), values[id_col].alias("doc_id"), leaf.alias("node"), F.when(where if where is not None else F.lit(False), given).alias("given"))
    rows = ranked(written(rows, "leaves"), [F.col("doc_id").asc_nulls_first(), F.col("node")], "tree")
    found = climbed(rows, ["doc_id", "given"], lambda tops: of_trees(tops, width, depth), width, depth)
    return found.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", "path", F.coalesce("given", "node").alias("given_leaf"))


def verified(proofs: DataFrame) -> DataFrame:
    """The manifest's rows with proof_sha256, folded_root (of the leaf as given and the path) and verified."""
    siblings = joined(F.transform("path", lambda p: F.concat(p["before"], p["after"])))
    folded = F.aggregate("path", F.col("given_leaf"), lambda node, p: digest(F.concat(p["before"], node, p["after"])))
    rows = proofs.withColumn("proof_sha256", digest(siblings)).withColumn("folded_root", folded)
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampered(text_col: str = "text", id_col: str = "doc_id") -> tuple[dict[str, Column], Column]:
    """The change that the query plays through: A-Z lower-cased where 3 divides the CRC-32 of the id. Rows without an id stay."""
    lowered = F.translate(F.col(text_col).cast("string"), UPPER, LOWER)
    return {text_col: lowered}, F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 0, F.lit(False))

"""N-gram Jaccard join by signature trees.

Sets are the distinct hashes of word shingles. Equal sets form a class, and one
document of each class goes on. The rest is exact:

1. Neighbourhoods. Two linked sets of at most ``top`` members differ in at most
   ``H = 2 top (1 - t) / (1 + t)`` of them. The hash range is cut into ``H + 1 + m`` parts,
   so linked sets agree in ``m + 1`` parts at least. A set signs its parts of two members
   or more; if more than ``m`` are smaller it signs those of one member too, and if more
   than ``m`` are empty, one mark for them. So linked sets share a signature, and a
   single frequent shingle is hardly ever one. Sizes fall into ranges, each half as long
   again; a set signs for its range, and for the next if partners can lie there.
   Documents that share a signature are neighbours; only connected neighbours can be linked.
2. Trees. The documents of a neighbourhood are leaves of a tree, ordered by size; its
   nodes hold the OR of their bitmaps and the range of sizes. Two nodes are compared
   from the root down, and a pair is left when the bits in common, plus the members
   that share a bit, stay below the overlap that the sizes demand. Pairs of leaves are
   verified on the sets, unless links found before already connect them.
3. Neighbourhoods beyond ``block`` documents are not compared as a whole. Documents meet
   first by the least signature they share, then by the greatest, in cells of a block
   each. What is left are signatures whose documents are not all connected by then:
   one cell each (once for all signatures of the same documents), or pairs of blocks
   that do not lie within one component. No task ever holds more than two blocks.

Components of the links are labelled with their least doc_id. Null, empty and
word-less texts have empty sets and are linked with nothing; a text of fewer words
than a shingle is one shingle. Equal rows are equal sets, so they share a component;
a null doc_id takes part and is never a label unless its whole component has none.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.common import components, likely, map_batches, mix, salted_join, shingle_hashes, star_batches, texts, word_hashes, written

FANOUT = 8
BITS = 2048
LEAST_PART = 2
MARKS = 1 << 23


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes of the text's words, A-Z in lower case."""
    return np.unique(shingle_hashes(word_hashes(text.lower().split()), size))


@lru_cache(maxsize=8)
def size_ranges(percent: int) -> np.ndarray:
    """First size of each range; a set's partners lie in its range or a neighbouring one."""
    firsts = [1]
    while firsts[-1] < 1 << 40:
        firsts.append(max(firsts[-1] * 100 // percent + 1, firsts[-1] * 3 // 2))
    return np.array(firsts, dtype=np.int64)


@lru_cache(maxsize=4096)
def part_starts(parts: int) -> np.ndarray:
    return np.array([(p << 64) // parts for p in range(1, parts)], dtype=np.uint64)


def signatures(members: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of the set's parts, for its size range and the next."""
    firsts, out = size_ranges(percent), []
    if not len(members):
        return np.zeros(0, dtype=np.int64)
    own = int(np.searchsorted(firsts, len(members), side="right")) - 1
    sums = np.zeros(len(members) + 1, dtype=np.uint64)
    spread = mix(members + np.uint64(1))
    np.cumsum(spread, out=sums[1:])
    reaches = 100 * len(members) >= percent * int(firsts[own + 1])
    for at in (own, own + 1) if reaches else (own,):
        differ = 2 * (int(firsts[at + 1]) - 1) * (100 - percent) // (100 + percent)
        if not differ:
            continue  # only equal sets are linked
        spare = differ // 10 + 3
        parts = differ + 1 + spare
        edges = np.concatenate(([0], np.searchsorted(members, part_starts(parts)), [len(members)]))
        counts = np.diff(edges)
        filled = np.flatnonzero(counts >= (LEAST_PART if (counts < LEAST_PART).sum() <= spare else 1))
        marks = mix(np.uint64(at << 40) + filled.astype(np.uint64))
        out.append(mix(sums[edges[filled + 1]] - sums[edges[filled]] + marks))
        if (counts == 0).sum() > spare:
            out.append(mix(np.array([(at << 40) + (1 << 39)], dtype=np.uint64)))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, dtype=np.int64)


class SignatureTree:
    """Nodes by level, leaves first: OR-combined bitmaps, size ranges, and the most members that share a bit."""

    def __init__(self, sets: list[np.ndarray]):
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self.order = np.lexsort((np.array([s[0] for s in sets], dtype=np.uint64), sizes))
        self.sets = [sets[k] for k in self.order]
        flags = np.zeros((len(sets), BITS), dtype=bool)
        for row, members in zip(flags, self.sets):
            row[(members & np.uint64(BITS - 1)).astype(np.int64)] = True
        bitmap = np.packbits(flags, axis=1).view(np.uint64)
        least = most = sizes[self.order]
        shared = sizes[self.order] - flags.sum(axis=1)
        self.levels = [(bitmap, least, most, shared)]
        while len(bitmap) > 1:
            starts = np.arange(0, len(bitmap), FANOUT)
            bitmap = np.bitwise_or.reduceat(bitmap, starts, axis=0)
            least, most, shared = np.minimum.reduceat(least, starts), np.maximum.reduceat(most, starts), np.maximum.reduceat(shared, starts)
            self.levels.append((bitmap, least, most, shared))

    def possible(self, level: int, x: np.ndarray, y: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Which node pairs may hold a link, and their bits in common."""
        bitmap, least, most, shared = self.levels[level]
        near = (100 * most[x] >= percent * least[y]) & (100 * most[y] >= percent * least[x])
        common = np.zeros(len(x), dtype=np.int64)
        for start in range(0, len(x), 1 << 16):
            part = slice(start, start + (1 << 16))
            common[part] = np.bitwise_count(bitmap[x[part]] & bitmap[y[part]]).sum(axis=1)
        overlap = np.minimum(common + np.minimum(shared[x], shared[y]), np.minimum(most[x], most[y]))
        return near & ((100 + percent) * overlap >= percent * (least[x] + least[y])), common

    def candidate_pairs(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Leaf pairs left by the dual traversal, the most alike first."""
        x = y = np.zeros(1, dtype=np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            keep, common = self.possible(level, x, y, percent)
            x, y, common = x[keep], y[keep], common[keep]
            if not level:
                break
            below = len(self.levels[level - 1][1])
            i, j = (a.ravel() for a in np.indices((FANOUT, FANOUT)))
            x, y = (x[:, None] * FANOUT + i).ravel(), (y[:, None] * FANOUT + j).ravel()
            real = (x <= y) & (y < below) if level > 1 else (x < y) & (y < below)
            x, y = x[real], y[real]
        else:
            common = np.zeros(0, dtype=np.int64)
        real = x < y
        order = np.argsort(-common[real], kind="stable")
        return x[real][order], y[real][order]

    def links(self, percent: int, known: list[int] | None = None) -> list[tuple[int, int]]:
        """Links that connect whatever links connect, as places in the given list; ``known`` holds labels already connected."""
        parent = list(range(len(self.sets)))
        if known is not None:
            first: dict[int, int] = {}
            parent = [first.setdefault(known[k], place) for place, k in enumerate(self.order)]

        def find(k: int) -> int:
            while parent[k] != k:
                parent[k] = k = parent[parent[k]]
            return k

        found = []
        for x, y in zip(*(a.tolist() for a in self.candidate_pairs(percent))):
            a, b = find(x), find(y)
            if a != b:
                left, right = self.sets[x], self.sets[y]
                both = len(np.intersect1d(left, right, assume_unique=True))
                if 100 * both >= percent * (len(left) + len(right) - both):
                    parent[b] = a
                    found.append((int(self.order[x]), int(self.order[y])))
        return found


def sets_of(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """rid, doc_id, n, digest of the set (null if empty), signatures and text, as a written table."""

    def work(batch: pa.RecordBatch):
        sizes, digests, marks = [], [], []
        for text in batch.column(2).to_pylist():
            members = shingle_set(text, words)
            sizes.append(len(members))
            digests.append(xxhash.xxh3_128_digest(members.tobytes()) if len(members) else None)
            marks.append(signatures(members, percent))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(marks, pa.list_(pa.int64())), batch.column(2)],
            names=["rid", "doc_id", "n", "digest", "marks", "text"],
        )

    rows = texts(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    return written(map_batches(rows, work, "rid long, doc_id long, n long, digest binary, marks array<long>, text binary"), "sets")


def neighbours(rows: DataFrame, most: int = MARKS) -> DataFrame:
    """Edges that connect the documents with the same signature, as stars.

    Signatures are dealt out in passes of about ``most``, up to 64 of them, so that not all lie on disk at once.
    """

    def work(batches):
        mark, first = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            marks, rids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.concatenate(([mark is None or marks[0] != mark], marks[1:] != marks[:-1]))
            starts = np.flatnonzero(new)
            heads = rids[starts[np.maximum(np.cumsum(new) - 1, 0)]] if len(starts) else np.full(len(rids), first)
            if len(starts):
                heads[: starts[0]] = first
            mark, first = marks[-1], heads[-1]
            edges = np.unique(np.column_stack((rids, heads))[rids != heads], axis=0)
            if len(edges):
                yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["u", "v"])

    marks = rows.select(F.explode("marks").alias("mark"), "rid")
    passes = min(64, -(-(rows.agg(F.sum(F.size("marks"))).first()[0] or 1) // most))
    edges = []
    for k in range(passes):
        own = marks.where(F.pmod("mark", F.lit(passes)) == k) if passes > 1 else marks
        met = own.repartition("mark").sortWithinPartitions("mark", "rid").mapInArrow(lambda batches: star_batches(work(batches)), "u long, v long")
        edges.append(written(met, "neighbours"))
    return reduce(DataFrame.union, edges)


def tree_links(cells: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (u, v) within each cell of (cell, rid, known, text)."""

    def close(rids: list[int], known: list[int], bodies: list[bytes]):
        if len(rids) > 1:
            found = SignatureTree([shingle_set(b, words) for b in bodies]).links(percent, known)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([rids[a] for a, _ in found], pa.int64()), pa.array([rids[b] for _, b in found], pa.int64())], names=["u", "v"])

    def work(batches):
        cell, rids, known, bodies = None, [], [], []
        for batch in batches:
            for at, rid, label, body in zip(*(c.to_pylist() for c in batch.columns)):
                if at != cell:
                    yield from close(rids, known, bodies)
                    cell, rids, known, bodies = at, [], [], []
                rids.append(rid)
                known.append(label)
                bodies.append(body)
        yield from close(rids, known, bodies)

    dealt = cells.select("cell", "rid", "known", "text").repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(work, "u long, v long")


def label_with(members: DataFrame, links: DataFrame) -> DataFrame:
    """``known`` of each member: the component of the links so far."""
    found = components(links).withColumnsRenamed({"node": "rid", "root": "_root"})
    return members.join(found, "rid", "left").withColumn("known", F.coalesce("_root", "rid")).drop("_root")


def large_links(members: DataFrame, words: int, percent: int, block: int, marks: DataFrame | None = None) -> DataFrame:
    """Links of neighbourhoods (near, rid, text) that hold more than ``block`` documents.

    ``marks`` (mark, rid) say which documents may be linked at all; without them all of a neighbourhood may.
    """

    bodies = members.select("rid", "text")
    bodies = bodies.dropDuplicates(["rid"]) if marks is None else bodies  # without marks a document may have several neighbourhoods

    def with_text(cells: DataFrame) -> DataFrame:
        """Cells are written first, so that texts meet no more than the documents asked for."""
        cells = written(cells, "cells")
        return likely(bodies, "rid", cells).join(cells, "rid")

    marks = members.select(F.col("near").alias("mark"), "rid") if marks is None else marks
    several = marks.groupBy("mark").agg(F.count("*").alias("size")).where("size > 1")
    marks = written(marks.join(several, "mark"), "marks")
    ends = marks.groupBy("rid").agg(F.min(F.struct("mark", "size")).alias("least"), F.max(F.struct("mark", "size")).alias("greatest"))

    def met(end: str, known: DataFrame) -> DataFrame:
        lots = F.ceil(F.col(f"{end}.size") / block)
        return known.join(ends, "rid").select(F.xxhash64(f"{end}.mark", F.pmod(F.xxhash64("rid"), lots)).alias("cell"), "rid", "known")

    known = marks.select("rid").distinct().withColumn("known", F.col("rid"))
    links = written(tree_links(with_text(met("least", known)), words, percent), "links-least")
    known = written(label_with(marks.select("rid").distinct(), links), "known-least")
    links = written(links.union(tree_links(with_text(met("greatest", known)), words, percent)), "links-greatest")
    known = written(label_with(marks.select("rid").distinct(), links), "known")
    shared = written(marks.select("mark", "rid").join(known, "rid"), "shared")
    # marks whose documents are not all connected yet; of marks with the same documents one is enough
    apart = shared.groupBy("mark").agg(F.min("known").alias("a"), F.max("known").alias("b"), F.count("*").alias("size"), F.bit_xor(F.xxhash64("rid")).alias("content"))
    chosen = apart.where("a <> b").groupBy("content", "size").agg(F.min("mark").alias("mark"))
    left_open = written(shared.join(chosen.select("mark", "size"), "mark"), "open")
    small = left_open.where(F.col("size") <= block).select(F.col("mark").alias("cell"), "rid", "known")

    marked = left_open.where(F.col("size") > block).select(F.col("mark").alias("near"), "rid", "known")
    parts = marked.groupBy("near", "known").agg(F.count("*").alias("size"))
    whole = F.col("size") * 2 >= block
    mixed = parts.where(~whole).groupBy("near").agg(F.sum("size").alias("mixed"))
    parts = parts.join(mixed, "near", "left").select(
        "near", "known", F.when(whole, F.col("known")).alias("pure"), F.when(whole, F.ceil(F.col("size") / block)).otherwise(F.ceil(F.col("mixed") / block)).alias("lots")
    )
    place = F.when(F.col("pure").isNotNull(), F.pmod(F.xxhash64("rid"), "lots")).otherwise(F.pmod(F.xxhash64("known"), "lots"))
    placed = marked.join(parts, ["near", "known"]).withColumn("home", F.xxhash64("near", "pure", place))
    homes = placed.groupBy("near", "home").agg(F.first("pure").alias("pure"))
    left = homes.select("near", F.col("home").alias("a"), F.col("pure").alias("pa"))
    right = homes.select("near", F.col("home").alias("b"), F.col("pure").alias("pb"))
    pairs = left.join(right, "near").where("a <= b and (pa is null or pb is null or pa <> pb)").select("a", "b", F.xxhash64("near", "a", "b").alias("cell"))
    sides = pairs.select(F.col("a").alias("home"), "cell").union(pairs.select(F.col("b").alias("home"), "cell")).distinct()
    rest = placed.select("home", "rid", "known").join(sides, "home").select("cell", "rid", "known")
    return links.union(tree_links(with_text(small.union(rest)), words, percent))


def near_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 85, block: int = 1024) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    rows = sets_of(docs, id_col, text_col, words, percent)
    classes = written(rows.where("digest is not null").groupBy("digest").agg(F.min("rid").alias("rep"), F.min("doc_id").alias("least")), "classes")
    first = likely(rows.select("rid", "marks"), "rid", classes.select(F.col("rep").alias("rid")))  # of equal sets one
    near = components(neighbours(first)).select(F.col("node").alias("rid"), F.col("root").alias("near"))
    near = written(near.join(classes.select(F.col("rep").alias("rid")), "rid"), "near")
    sizes = near.groupBy("near").agg(F.count("*").alias("size")).where("size > 1")
    kept = written(near.join(sizes, "near"), "kept")
    members = written(likely(rows.select("rid", "text"), "rid", kept).join(kept, "rid"), "members")
    small = members.where(F.col("size") <= block).select(F.col("near").alias("cell"), "rid", F.col("rid").alias("known"), "text")
    large = members.where(F.col("size") > block).select("near", "rid", "text")
    links = tree_links(small, words, percent)
    if not large.isEmpty():
        marks = likely(rows.select("rid", "marks"), "rid", large).join(large.select("rid"), "rid").select(F.explode("marks").alias("mark"), "rid")
        links = links.union(large_links(large, words, percent, block, written(marks, "marks")))
    linked = components(links).withColumnsRenamed({"node": "rep"})
    classes = classes.join(linked, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    labels = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(labels, "root").select("digest", "component_id")
    found = salted_join(rows.select("rid", "doc_id", "n", "digest"), named, "digest")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))

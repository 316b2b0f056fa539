"""Repeated strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte is removed if it lies in a string of ``length`` bytes that also starts anywhere
else, in the same or another text; strings are judged on the input. All steps are exact:

1. Equal texts form a class. In a class of several, every byte of a text of ``length``
   bytes or more goes; one text of the class stands for it in what follows.
2. Anchors. Of each window of ``length`` bytes the anchor is the ``GRAM``-byte string with
   the least hash (the leftmost of equal ones). Equal windows have equal anchors at equal
   places, so only windows whose anchor occurs twice or more can repeat. Their
   stretches, each with the windows of one anchor, are grouped by it; equal stretches
   are stored once, with their number.
3. Interval expansion. Groups are concatenated to blocks of bounded size. A block's
   suffixes are sorted by their first bytes up to beyond ``length``, which gives its
   transform; intervals are extended backward by one byte in breadth-first order,
   so common-prefix values appear in increasing order, and the search stops at
   ``length``. Borders not met until then separate nothing: what lies between two
   borders is one string of ``length`` bytes with all its occurrences.
4. A group larger than ``most_bytes`` is not given to one task: hashes of its windows are
   counted by an aggregation instead, with the same result.

Null texts are empty; texts shorter than ``length`` lose nothing. Equal rows count as
separate documents, null ids too. Texts are bytes, so a cut may split a character.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import likely, map_batches, mix, salted_join, texts, written

GRAM = 48
PIECE = 1 << 23
ODD = np.uint64(0x9E3779B97F4A7C15 | 1)
ODD_INVERSE = np.uint64(pow(int(ODD), -1, 1 << 64))
FEW = 48


def powers(base: np.uint64, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    if count:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Grams:
    """Hashes of all ``size``-byte strings of a text, by sums of byte values times powers modulo 2**64."""

    values = mix(np.arange(1, 257, dtype=np.uint64))

    def __init__(self):
        self.up, self.down = powers(ODD, 1 << 12), powers(ODD_INVERSE, 1 << 12)

    def __call__(self, data: np.ndarray, size: int) -> np.ndarray:
        if len(data) > len(self.up):
            count = 1 << int(len(data)).bit_length()
            self.up, self.down = powers(ODD, count), powers(ODD_INVERSE, count)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=sums[1:])
        return mix((sums[size:] - sums[:-size]) * self.down[: len(data) - size + 1])


grams = Grams()


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of ``width`` values, by prefix and suffix minima of blocks."""
    count = len(values) - width + 1
    rows = -(-len(values) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(values)] = values
    padded = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def anchors(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, and first and last window start, of each run of windows with one anchor."""
    data = np.frombuffer(text, dtype=np.uint8)
    found = []
    for start in range(0, len(data) - length + 1, PIECE):
        part = data[start : start + PIECE + length - 1]
        gram = min(GRAM, length)
        hashes = grams(part, gram)
        places = np.arange(len(hashes), dtype=np.uint64)
        least = least_in_windows((hashes & ~np.uint64((1 << 24) - 1)) | places, length - gram + 1)
        at = least & np.uint64((1 << 24) - 1)
        firsts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        lasts = np.concatenate((firsts[1:], [len(at)])) - 1
        found.append((hashes[at[firsts].astype(np.int64)], firsts + start, lasts + start))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found))


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` codes at least (codes below 512), by doubling."""
    n = len(codes)
    padded = np.zeros(n + 8, dtype=np.int64)
    padded[:n] = codes
    key = np.zeros(n, dtype=np.int64)
    for k in range(7):
        key = key << 9 | padded[k : n + k]
    order = np.argsort(key, kind="stable")
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    known = 7
    while True:
        ordered = key[order]
        new = np.concatenate(([False], ordered[1:] != ordered[:-1]))
        starts = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order] = starts
        if known >= depth:
            return order
        open_slots = np.flatnonzero(~new | np.concatenate((~new[1:], [False])))
        if len(open_slots) < 2:
            return order
        mine = order[open_slots]
        follow = rank[np.minimum(mine + known, n)]
        part = rank[mine] * (n + 2) + follow + 1
        order[open_slots] = mine[np.argsort(part, kind="stable")]
        key = rank[:n] * (n + 2) + rank[np.minimum(np.arange(n) + known, n)] + 1
        known *= 2


def repeat_borders(codes: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Places in the suffix order where a common prefix shorter than ``length`` begins."""
    n = len(codes)
    before = codes[order - 1]
    by_code = np.argsort(before, kind="stable")
    step = np.empty(n, dtype=np.int64)
    step[by_code] = np.arange(n)
    present, firsts = np.unique(before[by_code], return_index=True)
    lists = [by_code[a:b] for a, b in zip(firsts, [*firsts[1:], n])]
    border = np.zeros(n + 1, dtype=bool)
    border[0] = border[n] = True
    low, high = np.array([0]), np.array([n - 1])
    for _ in range(length):
        sizes = high - low + 1
        lows, highs = [], []
        one = sizes == 1
        at = low[one]
        at = at[before[at] != 0]
        lows.append(step[at])
        highs.append(step[at])
        some = (sizes > 1) & (sizes <= FEW)
        if some.any():
            count, start = sizes[some], low[some]
            owner = np.repeat(np.arange(len(count)), count)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + start[owner]
            key = owner * 512 + before[place]
            sort = np.argsort(key, kind="stable")
            key, place = key[sort], place[sort]
            first = np.concatenate(([True], key[1:] != key[:-1]))
            last = np.concatenate((first[1:], [True]))
            real = key[first] % 512 != 0
            lows.append(step[place[first]][real])
            highs.append(step[place[last]][real])
        many = sizes > FEW
        if many.any():
            a, b = low[many], high[many]
            for code, places, first in zip(present, lists, firsts):
                if code:
                    x, y = np.searchsorted(places, a), np.searchsorted(places, b, side="right")
                    real = y > x
                    lows.append(first + x[real])
                    highs.append(first + y[real] - 1)
        low, high = np.concatenate(lows), np.concatenate(highs)
        fresh = ~border[high + 1]
        low, high = low[fresh], high[fresh]
        if not len(low):
            break
        border[high + 1] = True
    return border


def repeated_starts(stretches: list[bytes], weights: list[int], length: int) -> list[np.ndarray]:
    """Of each stretch, the window starts whose string has occurrences of weight two or more."""
    sizes = np.array([len(s) for s in stretches], dtype=np.int64)
    codes = np.zeros(int(sizes.sum()) + len(sizes), dtype=np.int16)
    starts = np.cumsum(sizes + 1) - sizes - 1
    for start, stretch in zip(starts, stretches):
        codes[start : start + len(stretch)] = np.frombuffer(stretch, dtype=np.uint8)
        codes[start : start + len(stretch)] += 1
    order = suffix_order(codes, length + 1)
    border = repeat_borders(codes, order, length)
    weight = np.zeros(len(codes), dtype=np.int64)
    for start, size, w in zip(starts, sizes, weights):
        weight[start : start + size - length + 1] = w
    heads = np.flatnonzero(border[:-1])
    totals = np.add.reduceat(weight[order], heads)
    twice = np.empty(len(codes), dtype=bool)
    twice[order] = np.repeat(totals >= 2, np.diff(np.append(heads, len(codes))))
    twice &= weight > 0
    return [np.flatnonzero(twice[start : start + size]) for start, size in zip(starts, sizes)]


def runs(places: np.ndarray) -> list[dict]:
    """Sorted places as runs."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1)
    return [{"a": int(a), "b": int(b)} for a, b in zip(places[np.concatenate(([0], cut + 1))], places[np.concatenate((cut, [len(places) - 1]))])]


RUNS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def read_texts(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """rid, doc_id, size, digest, SHA-256, anchors and text, as a written table."""

    def work(batch: pa.RecordBatch):
        digests, sums, marks, firsts, lasts = [], [], [], [], []
        bodies = batch.column(2).to_pylist()
        for text in bodies:
            digests.append(xxhash.xxh3_128_digest(text))
            sums.append(hashlib.sha256(text).hexdigest())
            mark, first, last = anchors(text, length)
            marks.append(mark.view(np.int64))
            firsts.append(first)
            lasts.append(last)
        spans = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([len(t) for t in bodies], pa.int64()), pa.array(digests, pa.binary()), pa.array(sums, pa.string()),
             pa.array(marks, spans), pa.array(firsts, spans), pa.array(lasts, spans), batch.column(2)],
            names=["rid", "doc_id", "n_bytes", "digest", "sha256", "marks", "firsts", "lasts", "text"],
        )

    rows = texts(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    schema = "rid long, doc_id long, n_bytes long, digest binary, sha256 string, marks array<long>, firsts array<long>, lasts array<long>, text binary"
    return written(map_batches(rows, work, schema), "texts")


def stretches_of(rows: DataFrame, shown: DataFrame, length: int) -> DataFrame:
    """sid, mark, rid, first, size and (once per batch) bytes of each stretch, as a written table."""

    def work(batch: pa.RecordBatch):
        out: list[tuple] = []
        seen: set[bytes] = set()
        for rid, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
            for span in spans:
                body = text[span["first"] : span["last"] + length]
                sid = xxhash.xxh3_128_digest(body)
                out.append((sid, span["mark"], rid, span["first"], len(body), None if sid in seen else body))
                seen.add(sid)
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        columns = zip(*out) if out else [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["sid", "mark", "rid", "first", "size", "body"])

    spans = F.explode(F.arrays_zip(F.col("marks").alias("mark"), F.col("firsts").alias("first"), F.col("lasts").alias("last"))).alias("s")
    found = shown.select("rid", spans).select("rid", "s.mark", "s.first", "s.last")
    often = found.groupBy("mark").agg(F.count("*").alias("k")).where("k > 1").select("mark")
    mine = found.join(often, "mark").groupBy("rid").agg(F.collect_list(F.struct("mark", "first", "last")).alias("spans"))  # within one text
    mine = written(mine, "spans")
    bodies = likely(rows.select("rid", "text"), "rid", mine).join(mine, "rid")
    return written(map_batches(bodies, work, "sid binary, mark long, rid long, first long, size long, body binary"), "stretches")


def expand_groups(stored: DataFrame, length: int, block_bytes: int) -> DataFrame:
    """(sid, runs of repeated window starts) by interval expansion over blocks of whole groups."""

    def close(sids: list, bodies: list, weights: list):
        if bodies:
            found = repeated_starts(bodies, weights, length)
            hits = [(s, runs(f)) for s, f in zip(sids, found) if len(f)]
            if hits:
                yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits], pa.binary()), pa.array([h[1] for h in hits], RUNS)], names=["sid", "runs"])

    def work(batches):
        block, size, group, last = [], 0, [], None

        def grouped():
            """The group just read goes to the block; one stretch that occurs more than once repeats as a whole."""
            nonlocal size
            if len(group) == 1 and group[0][1] > 1:
                sid, _, body = group[0]
                whole = [{"a": 0, "b": len(body) - length}] if len(body) >= length else []
                yield pa.RecordBatch.from_arrays([pa.array([sid], pa.binary()), pa.array([whole], RUNS)], names=["sid", "runs"])
            else:
                block.extend(group)
                size += sum(len(body) for _, _, body in group)

        for batch in batches:
            for sid, mark, weight, body in zip(*(c.to_pylist() for c in batch.columns)):
                if mark != last:
                    yield from grouped()
                    group = []
                    if size >= block_bytes:
                        yield from close([s for s, _, _ in block], [b for _, _, b in block], [w for _, w, _ in block])
                        block, size = [], 0
                group.append((sid, min(weight, 2), body))
                last = mark
        yield from grouped()
        yield from close([s for s, _, _ in block], [b for _, _, b in block], [w for _, w, _ in block])

    dealt = stored.select("sid", "mark", "n", "body").repartition("mark").sortWithinPartitions("mark")
    return dealt.mapInArrow(work, "sid binary, runs array<struct<a: long, b: long>>")


def count_windows(stored: DataFrame, length: int) -> DataFrame:
    """The same for groups of any size, by counting hashes of windows."""

    def work(batch: pa.RecordBatch):
        for sid, weight, body in zip(*(c.to_pylist() for c in batch.columns)):
            hashes = grams(np.frombuffer(body, dtype=np.uint8), length).view(np.int64)
            n = len(hashes)
            yield pa.RecordBatch.from_arrays(
                [pa.array([sid] * n, pa.binary()), pa.array(range(n), pa.int64()), pa.array([min(weight, 2)] * n, pa.int64()), pa.array(hashes)],
                names=["sid", "a", "n", "window"],
            )

    windows = written(map_batches(stored.select("sid", "n", "body"), work, "sid binary, a long, n long, window long"), "windows")
    twice = windows.groupBy("window").agg(F.sum("n").alias("k")).where("k > 1").select("window")
    hits = windows.join(twice, "window").groupBy("sid").agg(F.collect_list(F.struct("a", F.col("a").alias("b"))).alias("runs"))  # within one stretch
    return hits


def removed_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400, block_bytes: int = 2 << 20, most_bytes: int = 8 << 20) -> tuple[DataFrame, DataFrame]:
    """The texts (see ``read_texts``), and their classes with the byte spans [a, b) to remove from the text that stands for each."""
    rows = read_texts(docs, id_col, text_col, length)
    classes = written(rows.groupBy("digest").agg(F.min("rid").alias("rep"), F.count("*").alias("copies")), "classes")
    shown = rows.select("rid", "marks", "firsts", "lasts").where(F.size("marks") > 0).join(classes.select(F.col("rep").alias("rid")), "rid", "left_semi")
    pieces = stretches_of(rows, shown, length)
    stored = written(pieces.groupBy("sid").agg(F.count("*").alias("n"), F.first("mark").alias("mark"), F.first("body", ignorenulls=True).alias("body")), "stored")
    large = stored.groupBy("mark").agg(F.sum(F.length("body")).alias("size")).where(F.col("size") > most_bytes).select("mark")
    large = written(large, "large")
    if large.isEmpty():
        found = expand_groups(stored, length, block_bytes)
    else:
        found = expand_groups(stored.join(large, "mark", "left_anti"), length, block_bytes)
        found = found.union(count_windows(stored.join(large, "mark", "left_semi"), length).select("sid", "runs"))
    placed = salted_join(pieces.select("sid", "rid", "first"), written(found, "found"), "sid", how="inner")
    shifted = F.transform("runs", lambda r: F.struct((r["a"] + F.col("first")).alias("a"), (r["b"] + F.col("first") + length).alias("b")))
    spans = placed.groupBy("rid").agg(F.array_sort(F.flatten(F.collect_list(shifted))).alias("spans"))
    return rows, classes.join(spans.withColumnRenamed("rid", "rep"), "rep", "left")


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of sorted [a, b) spans."""
    out: list[tuple[int, int]] = []
    for span in spans:
        a, b = span["a"], span["b"]
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(b for _, b in spans)]
    return b"".join(text[a:b] for a, b in zip(ends, [*(a for a, _ in spans), len(text)]))


def remove_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400, keep_text: bool = False, changed_only: bool = False, **limits
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    With ``keep_text`` also ``sha256`` of the input text and what remains, without halves of characters.
    ``changed_only`` gives only the documents of which something goes, and carries no other texts.
    """
    rows, classes = removed_spans(docs, id_col=id_col, text_col=text_col, length=length, **limits)

    def work(batch: pa.RecordBatch):
        reps, count, gone, sums, left = [], [], [], [], []
        for rep, spans, text in zip(*(c.to_pylist() for c in batch.columns)):
            spans = merged(spans)
            body = cut(text, spans)
            reps.append(rep)
            count.append(len(spans))
            gone.append(len(text) - len(body))
            sums.append(hashlib.sha256(body).hexdigest())
            left.append(body.decode("utf-8", "ignore") if keep_text else None)
        yield pa.RecordBatch.from_arrays(
            [pa.array(reps, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(sums, pa.string()), pa.array(left, pa.string())],
            names=["rep", "n_removed", "n_spans", "kept_sha256", "kept"],
        )

    copied = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    cuts = written(classes.where("copies = 1 and spans is not null").select("rep", "spans"), "cuts")
    affected = likely(rows.select(F.col("rid").alias("rep"), "text"), "rep", cuts).join(cuts, "rep").select("rep", "spans", "text")
    done = map_batches(affected, work, "rep long, n_removed long, n_spans long, kept_sha256 string, kept string")
    unchanged = ["text"] if keep_text and not changed_only else []
    named = salted_join(rows.select("rid", "doc_id", "n_bytes", "digest", "sha256", *unchanged), classes.select("digest", "copies"), "digest")
    joined = named.join(done.withColumnRenamed("rep", "rid"), "rid", "left")
    out = [
        "doc_id", "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    ]
    if keep_text:
        own = [F.col("text").cast("string")] if unchanged else []
        out += ["sha256", F.when(copied, F.lit("")).otherwise(F.coalesce("kept", *own)).alias("kept")]
    found = joined.select(*out)
    return found.where("n_removed > 0") if changed_only else found

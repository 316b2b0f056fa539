"""Signature trees, repeated strings and paragraph bands beside brute force."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tallybook.llm import common, near_join, paragraphs, repeats
from tallybook.llm.common import components, fold_words, likely

WORDS = [f"{a}{b}" for a in "bcdfghjklm" for b in ("ar", "en", "il", "osh", "ut")]


def prose(draw, n):
    return [draw.choice(WORDS) + draw.choice(WORDS) for _ in range(n)]


def corpus(seed, groups=6, copies=12, size=120):
    draw = random.Random(seed)
    out = []
    for _ in range(groups):
        base = prose(draw, draw.randrange(5, size))
        for _ in range(draw.randrange(1, copies)):
            words = list(base)
            for _ in range(draw.randrange(0, 4)):
                words[draw.randrange(len(words))] = "edit" + str(draw.randrange(5))
            if draw.random() < 0.2:
                words = words[: -draw.randrange(1, 4)] or words
            out.append(" ".join(words))
    return out


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(size))))


def linked(sets, percent):
    parent = {k: k for k in range(len(sets))}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(len(sets))]


@pytest.mark.parametrize("seed", range(30))
def test_tree_links(seed):
    texts = [t for t in corpus(seed) if t]
    sets = [near_join.shingle_set(t.encode(), 4) for t in texts]
    want = linked([shingles(t, 4) for t in texts], 85)
    parent = list(range(len(texts)))
    for a, b in near_join.SignatureTree(sets).links(85):
        old, new = parent[a], parent[b]
        parent = [new if p == old else p for p in parent]
    assert len(set(zip(want, parent))) == len(set(want)) == len(set(parent))


@pytest.mark.parametrize("seed", range(20))
def test_linked_sets_share_a_signature(seed):
    texts = corpus(100 + seed, size=400)
    sets = [near_join.shingle_set(t.encode(), 4) for t in texts]
    marks = [set(near_join.signatures(s, 85).tolist()) for s in sets]
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            union = len(sets[a]) + len(sets[b]) - both
            if both < union and 100 * both >= 85 * union:
                assert marks[a] & marks[b]


@pytest.mark.parametrize("block", [2, 512])
def test_near_components(spark, block):
    texts = corpus(7, groups=5, copies=25) + ["", None, "two words"] * 2
    ids = [3 * k + 1 for k in range(len(texts))]
    random.Random(1).shuffle(ids)
    want = dict(zip(ids, linked([shingles(t, 4) for t in texts], 85)))
    least = {}
    for i in ids:
        least[want[i]] = min(i, least.get(want[i], i))
    got = {r.doc_id: r for r in near_join.near_components(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string"), block=block).collect()}
    assert {i: got[i].component_id for i in ids} == {i: least[want[i]] for i in ids}
    assert all(got[i].n_shingles == len(shingles(t, 4)) for i, t in zip(ids, texts))


def test_near_components_of_odd_rows(odd_docs, no_docs):
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in near_join.near_components(odd_docs).collect())
    assert got == [(0, 0), (0, 5), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (5, 5), (6, 5), (7, 7), (8, 8), (9, 9), (9, 9)]
    assert near_join.near_components(no_docs).count() == 0


def test_components(spark):
    chain = [(k, k + 1) for k in range(30)] + [(50, 60), (60, 50), (70, 70), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(31)}, 50: 50, 60: 50, 70: 70}


def test_likely_loses_nothing(spark):
    wanted = spark.range(0, 100_000, 997).withColumnRenamed("id", "k")
    found = likely(spark.range(100_000).withColumnRenamed("id", "k"), "k", wanted)
    assert found.join(wanted, "k").count() == wanted.count() and found.count() < 2 * wanted.count()


@pytest.mark.parametrize("seed", range(60))
def test_repeated_starts(seed):
    draw = random.Random(seed)
    length = draw.choice([5, 8, 50])
    base = "".join(draw.choice("ab c") for _ in range(200))
    stretches = []
    for _ in range(draw.randrange(1, 8)):
        at = draw.randrange(150)
        piece = list(base[at : at + draw.randrange(length, length + 100)])
        if draw.random() < 0.6:
            piece[draw.randrange(len(piece))] = draw.choice("xyz")
        stretches.append("".join(piece).encode() + bytes(draw.randrange(256) for _ in range(draw.choice([0, 60]))))
    stretches = [s for s in stretches if len(s) >= length] or [b"a" * length]
    weights = [draw.choice([1, 1, 2]) for _ in stretches]
    counts = collections.Counter()
    for s, w in zip(stretches, weights):
        for k in range(len(s) - length + 1):
            counts[s[k : k + length]] += w
    want = [[k for k in range(len(s) - length + 1) if counts[s[k : k + length]] > 1] for s in stretches]
    assert [g.tolist() for g in repeats.repeated_starts(stretches, weights, length)] == want


def brute_removal(bodies, length):
    counts = collections.Counter(b[k : k + length] for b in bodies for k in range(len(b) - length + 1))
    out = []
    for body in bodies:
        gone = np.zeros(len(body) + 1, dtype=bool)
        for k in range(len(body) - length + 1):
            if counts[body[k : k + length]] > 1:
                gone[k : k + length] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(b for b, g in zip(body, gone) if not g)
        out.append((len(body), len(body) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("limits", [{}, {"most_bytes": 200, "block_bytes": 500}])
def test_remove_repeats(spark, odd_docs, limits):
    draw = random.Random(2)
    shared = " ".join(prose(draw, 30))
    texts = [" ".join(prose(draw, 30)) + shared[draw.randrange(60) :] + " ".join(prose(draw, 10)) for _ in range(25)] + ["ab" * 500, None, "", shared, shared]
    rows = list(enumerate(texts)) + [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=100, **limits).collect()
    want = brute_removal([(t or "").encode() for _, t in rows], 100)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got), key=key) == sorted([(i, *w) for (i, _), w in zip(rows, want)], key=key)


def test_kept_text_and_no_rows(spark, no_docs):
    rows = [(1, "start é" + "é" * 80 + " one"), (2, "other è" + "é" * 80 + " two")]
    kept = {r.doc_id: r.kept for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=100, keep_text=True).collect()}
    assert kept[1].startswith("start") and kept[1].endswith("one") and kept[2].endswith("two") and len(kept[1]) < 20
    assert repeats.remove_repeats(no_docs).count() == 0


def test_tuned_bands():
    bands = paragraphs.tune(0.8, 0.999)
    assert (1 - 0.64) ** bands <= 0.001 < (1 - 0.64) ** (bands - 1)


@pytest.mark.parametrize("block", [2, 256])
def test_paragraph_clusters(spark, block):
    """Every pair at the similarity is in one cluster, and clusters hold linked paragraphs only."""
    draw = random.Random(5)
    lines = [" ".join(prose(draw, 60)) for _ in range(6)]
    texts = []
    for k in range(40):
        words = draw.choice(lines).split()
        if k % 3:
            words[draw.randrange(len(words))] = "edit"
        texts.append(" ".join(prose(draw, 30)) + "\n" + " ".join(words) + "\n" + " ".join(prose(draw, 30)))
    got = paragraphs.paragraph_clusters(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=block).collect()
    pieces = [(i, p[0], p[1], b" ".join(p[2]).decode()) for i, t in enumerate(texts) for p in paragraphs.paragraphs(t.encode(), 8)]
    roots = linked([shingles(p[3], 5) for p in pieces], 80)
    size = collections.Counter(roots)
    want = {(p[0], p[1], p[2]): r for p, r in zip(pieces, roots) if size[r] > 1}
    assert {(r.doc_id, r.start, r.stop) for r in got} == set(want)
    assert len({(want[r.doc_id, r.start, r.stop], r.component_id) for r in got}) == len(set(want.values()))
    stay = collections.Counter(r.component_id for r in got if not r.removed)
    assert set(stay.values()) == {1} and all(r.kept_doc_id <= r.doc_id for r in got)


def test_paragraphs_cover_passages():
    draw = random.Random(9)
    passage = ". ".join(" ".join(prose(draw, 12)) for _ in range(6)) + "."
    found = []
    for _ in range(2):
        text = " ".join(prose(draw, 17)) + " " + passage + " " + " ".join(prose(draw, 23))
        found.append({tuple(p[2]) for p in paragraphs.paragraphs(text.encode(), 8)})
    assert sum(len(p) for p in found[0] & found[1]) >= 48
    assert [fold_words(b"A-b")] == [[b"a", b"b"]]


def test_paragraphs_of_odd_rows(odd_docs, no_docs):
    rows = paragraphs.paragraph_clusters(odd_docs).collect()
    assert {r.doc_id for r in rows} >= {5, 6, 9, None} and not {1, 2, 3, 4, 7, 8} & {r.doc_id for r in rows}
    assert paragraphs.paragraph_clusters(no_docs).count() == 0


@pytest.mark.parametrize("changed", [False, True])
def test_passages_inside_running_text(spark, changed):
    """Passages of 51 to 60 words between foreign words, without or with sentence ends, also with a word changed."""
    draw = random.Random(17)
    rows, want = [], {}
    for n in range(51, 61):
        words = prose(draw, n)
        if n % 2:
            words[30] += "."
        for k in range(2):
            own = list(words)
            if k and changed:
                own[draw.randrange(n)] = "edit"
            before, after = " ".join(prose(draw, 15 + 9 * k)), " ".join(prose(draw, 20 + 7 * k))
            passage = " ".join(own)
            rows.append((2 * n + k, f"{before} {passage} {after}"))
            want[2 * n + k] = (len(before) + 1, len(before) + 1 + len(passage))
    rows.append((1, " ".join(prose(draw, 200))))
    got = paragraphs.paragraph_clusters(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = dict(rows)
    for doc, (start, stop) in want.items():
        mine = [r for r in got if r.doc_id == doc and r.place is None]
        covered = {b for r in mine for b in range(r.start, r.stop)}
        assert covered <= set(range(start, stop)) and len(texts[doc][start:stop].split()) >= 51
        kept = " ".join("".join(c if b in covered else " " for b, c in enumerate(texts[doc])).split())
        assert len(kept.split()) >= (25 if changed else len(texts[doc][start:stop].split()) - 8)
        assert {r.removed for r in mine} == {doc % 2 == 1} and {r.kept_doc_id for r in mine} == {doc - doc % 2}
    assert {r.doc_id for r in got} == set(want)


def test_rest_of_a_text_is_a_paragraph():
    found = paragraphs.paragraphs(b"one two three four five six seven eight.\nnine ten", 8)
    assert [len(p[2]) for p in found] == [8, 2] and found[-1][1] == 49


def test_components_of_nodes_below_two_roots(spark):
    """5 lies below 10 and 11, whose other ends 1 and 2 have no link but through it."""
    edges = spark.createDataFrame([(10, 5), (10, 1), (11, 5), (11, 2), (20, 20), (None, 1)], "u long, v long")
    assert {r.node: r.root for r in common.components(edges).collect()} == {1: 1, 2: 1, 5: 1, 10: 1, 11: 1, 20: 20}


@pytest.mark.parametrize("chunk", [1, 50, 1 << 18])
def test_stars_of_a_path(monkeypatch, chunk):
    monkeypatch.setattr(common, "CHUNK", chunk)
    path = np.array([(k * 7 % 101, (k + 1) * 7 % 101) for k in range(60)])
    batches = [pa.RecordBatch.from_arrays([path[k : k + 10, 0].copy(), path[k : k + 10, 1].copy()], names=["u", "v"]) for k in range(0, 60, 10)]
    found = [tuple(r.values()) for b in common.star_batches(iter(batches)) for r in b.to_pylist()]
    assert all(u > v for u, v in found) and len({frozenset(x) for x in found}) >= 60
    parts = {r: {r} for r in {*path.ravel().tolist()}}
    for u, v in found:
        parts[u] |= parts[v]
        for r in parts[u]:
            parts[r] = parts[u]
    assert len(parts[0]) == 61


def test_signatures_in_passes(spark):
    marks = [(r, [r // 2 * 10, (r + 1) // 2 * 10 + 5]) for r in range(9)]
    rows = spark.createDataFrame([*marks, (20, [7]), (21, [])], "rid long, marks array<long>")
    for most in (4, 1 << 23):
        assert {r.node for r in common.components(near_join.neighbours(rows, most)).where("root = 0").collect()} == set(range(9))

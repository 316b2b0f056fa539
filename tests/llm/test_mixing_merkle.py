"""Source mixing, Merkle manifest, importance resampling: brute force, odd rows, ties, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybook.llm import merkle, mixing, ranks, resampling

WORDS, FOLDED = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(merkle.UPPER, merkle.LOWER)
CLASHING = "doc_id long, text string, source string, lang string, n_chars long, src string, at long, total long, tree string, node string, size int, _row int, kids int"


def documents(spark, seed=1, n=400, odd=True):
    rng = random.Random(seed)
    words = ["Harbour", "tide", "été", "Mast9", "x-y", "한글", "KEEL", "a"]
    rows = []
    for k in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 30, 90])))
        source, lang = rng.choice(["a", "a", "a", "b", "B", "é", "", "deep"]), rng.choice(["en", "en", "en", "fr", "ko"])
        rows.append([k, text, source, lang, len(text)])
    if odd:
        rows += [[None, "no id here", "a", "en", 3], [None, None, None, None, None], [1000, None, None, "en", 0], [1001, "", "b", None, 0], [1002, " \t\n ", "b", "fr", 4]]
        rows += [[2000, "the same row of copies " * 3, "copies", "cp", 9]] * 120 + [[2001, "Long " * 30_000, "long", "en", 1]]
        rows += [[3000, "two texts", "a", "en", 9], [3000, "of one id", "a", "en", 9]]
    return rows, spark.createDataFrame([(*r, "s", 1, 2, "t", "n", 3, 4, 5) for r in rows], CLASHING).repartition(5)


def wanted_targets(sizes):
    """Reshare by hand until none is above three times its size. Sources in order, null last."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    full = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        shares = sum(weight[s] for s in order if s not in full)
        target = {s: 3 * sizes[s] if s in full else left * weight[s] / shares for s in order}
        above = {s for s in order if target[s] > 3 * sizes[s] * (1 + 1e-12)}
        if not above:
            return target
        full |= above


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing(spark, seed):
    rows, docs = documents(spark, seed)
    count = lambda text: len(WORDS.findall(text or ""))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += count(r[1])
    target = wanted_targets(sizes)
    got = mixing.mix_sources(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((r[0] is None, r[0] or 0, count(r[1])) for r in rows)
    by_target = defaultdict(list)
    for r in got:
        by_target[r.source_size, round(r.target, 6)].append(r)
        assert r.size == 0 and r.taken == 0 or r.taken in [r.size * k for k in range(4)]
    for s, t in target.items():
        own = by_target[sizes[s], round(t, 6)]
        assert own, s
        same = [x for x in target if (sizes[x], round(target[x], 6)) == (sizes[s], round(t, 6))]
        assert abs(sum(r.taken for r in own) / len(same) - t) <= max(r.size for r in own) / 2 + 1e-6, s
    again = mixing.mix_sources(docs.repartition(2)).collect()
    assert Counter(again) == Counter(got)


def test_mixing_threshold_among_equal_rows(spark):
    """Of 100 equal rows some are taken twice, the others once; their words come within half a row of the target."""
    rows = [(7, "one two three four", "a")] * 100 + [(8, "w " * 1000, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [r for r in mixing.mix_sources(docs).collect() if r.doc_id == 7]
    target = 1400 / 3  # a weighs 1 of 3
    assert len(got) == 100 and abs(sum(r.taken for r in got) - target) <= 2 and {r.taken for r in got} == {4, 8}


def test_mixing_copies_in_lots(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES_A_ROW", 7)
    docs = spark.createDataFrame([(7, "one two", "a")] * 50 + [(8, "w " * 90, "b")], "doc_id long, text string, source string")
    got = [r.taken for r in mixing.mix_sources(docs).collect() if r.doc_id == 7]
    assert len(got) == 50 and abs(sum(got) - 190 / 3) <= 1


def test_word_count(spark):
    texts = ["", None, " ", "a", " a  b\t\nc\r", "\x0b\x0c", "x y z", "\U0001f389 b", "a\x00b"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.word_count(F.col("t"))).collect()]
    assert got == [len(WORDS.findall(t or "")) for t in texts]


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, lowered=False):
    doc_id, text, source, lang, n_chars = row
    values = [doc_id, source, lang, n_chars, text.translate(LOWER) if lowered and text else text]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree_of(nodes):
    """Levels of a tree from its leaves."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h("".join(last[k : k + 8])) for k in range(0, len(last), 8)])
    return levels


def path_of(levels, place):
    found = []
    for level in levels[:-1]:
        start = place - place % 8
        found.append((level[start:place], level[place + 1 : start + 8]))
        place //= 8
    return found


def wanted_manifest(rows):
    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r[3]].append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    for own in by_lang.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {x: tree_of([leaf(r) for r in by_lang[x]]) for x in langs}
    top = tree_of([trees[x][-1][0] for x in langs])
    found = []
    for k, x in enumerate(langs):
        for place, r in enumerate(by_lang[x]):
            path = path_of(trees[x], place) + path_of(top, k)
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            node = leaf(r, changed)
            for before, after in path:
                node = h("".join([*before, node, *after]))
            proof = h("".join("".join(before + after) for before, after in path))
            found.append((r[0], leaf(r), trees[x][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return Counter(found)


def got_manifest(docs, **how):
    changed, where = merkle.tampered()
    proofs = merkle.verified(merkle.manifest(docs, changed, where, **how))
    return Counter(tuple(r) for r in proofs.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())




@pytest.mark.parametrize("depth", [1, 2, 3])
def test_manifest(spark, depth):
    rows, docs = documents(spark)
    assert got_manifest(docs, depth=depth) == wanted_manifest(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 64, 65, 73, 513])
def test_manifest_of_one_tree(spark, n):
    rows, docs = documents(spark, n=n, odd=False)
    for r in rows:
        r[3] = "en"
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    assert got_manifest(docs) == wanted_manifest(rows)


def test_places_of_ties(spark):
    rows = spark.createDataFrame([("g", 5)] * 1000 + [("g", 1)] * 30 + [("k", 5)] * 3, "g string, v long")
    placed = ranks.ranked(rows.repartition(7), [F.col("v")], "g", rows_a_range=50).collect()
    assert sorted(r.at for r in placed if r.g == "g") == list(range(1030)) and {r.total for r in placed if r.g == "g"} == {1030}
    assert all(r.at < 30 for r in placed if r.g == "g" and r.v == 1) and sorted(r.at for r in placed if r.g == "k") == [0, 1, 2]


def wanted_draw(rows, target, longest=1, least=20):
    grams = lambda text: [" ".join(w[i : i + n]) for w in [FOLDED.findall((text or "").translate(LOWER))] for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    bucket = lambda g: zlib.crc32(g.encode()) % 10000
    s, t = Counter(bucket(g) for r in rows for g in grams(r[1])), Counter(bucket(g) for x in target for g in grams(x))
    total, asked = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total + 10000) / ((s[b] + 1) * (asked + 10000)))) for b in s}
    found = []
    for r in rows:
        own = grams(r[1])
        weight = sum(gain[bucket(g)] for g in own)
        u = (int(h(f"2024:{'' if r[0] is None else r[0]}")[:8], 16) + 0.5) / 4294967296
        found.append([r[0], len(own), weight, weight + math.floor(-1000 * math.log(-math.log(u))), None, len(FOLDED.findall((r[1] or "").translate(LOWER)))])
    drawable = sorted((f for f in found if f[5] >= least), key=lambda f: (-f[3], f[0] is None, f[0] or 0))
    for place, f in enumerate(drawable[: 10 * len(drawable) // 100]):
        f[4] = place + 1
    return Counter(tuple(f[:5]) for f in found)


TARGET = ["Harbour tide tide", None, "", "the same row of copies, keel", "été " * 40]


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling(spark, longest):
    rows, docs = documents(spark)
    target = spark.createDataFrame([(t, 1, 2) for t in TARGET], "text string, doc_id int, bucket int")
    got = Counter(tuple(r) for r in resampling.resample(docs, target, longest=longest).collect())
    assert got == wanted_draw(rows, TARGET, longest)


def test_resampling_of_nothing(spark):
    rows, docs = documents(spark, n=60, odd=False)
    none = docs.limit(0)
    assert resampling.resample(none, docs).count() == 0
    assert Counter(tuple(r) for r in resampling.resample(docs, none).collect()) == wanted_draw(rows, [])


@pytest.mark.parametrize("block_bytes", [1, 7, 40, 10_000])
def test_blocks_lose_and_repeat_no_gram(block_bytes):
    rng = random.Random(block_bytes)
    texts = [" ".join(rng.choice(["aa", "b", "ccc", "é"]) for _ in range(rng.randint(0, 30))).encode() for _ in range(20)] + [b"", b"x" * 50]
    for longest in (1, 2, 4):
        found = Counter()
        for _, carried, block in resampling.blocks_of(iter(texts), longest, block_bytes):
            starts, ends, _, _ = resampling.occurrences(block, carried, longest)
            table = resampling.Interned(block, starts, ends, 10_000)
            pieces = [block[a:b] for a, b in zip(starts, ends)]
            found.update(pieces)
            held = dict(zip(table.slot.tolist(), pieces))
            assert all(held[s] == p for s, p in zip(table.slot.tolist(), pieces)) and len(held) == len(set(pieces))
            assert all(table.bucket[s] == zlib.crc32(p) % 10_000 for s, p in held.items())
            assert {p: table.count[s] for s, p in held.items()} == Counter(pieces)
        words = [t.split() for t in texts]
        assert found == Counter(b" ".join(w[i : i + n]) for w in words for n in range(1, longest + 1) for i in range(len(w) - n + 1))


def test_colliding_keys_keep_apart(monkeypatch):
    """Equal 64-bit keys of unequal bytes take slots of their own."""
    monkeypatch.setattr(resampling.xxhash, "xxh64_intdigest", lambda piece: len(piece))
    block = b"ab cd ab ef gh cd abc"
    starts, ends, _, _ = resampling.occurrences(block, [0], 1)
    table = resampling.Interned(block, starts, ends, 10_000)
    assert np.unique(table.slot).size == 5 and sorted(table.count[table.count > 0].tolist()) == [1, 1, 1, 2, 2]

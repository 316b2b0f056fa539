"""Site templates, positional index, quality forest, licence rules, toxicity and the pipeline."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybook.llm import decontaminate, licences, quality, registered, templates, toxicity
from tallybook.llm.common import fold_words, table

PAGE = (
    "<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
    "<header><div class='brand'>The Site</div></header><nav><ul><li><a href='/a'>Home</a></li></ul></nav>"
    "<div class='cookie-notice'>We use cookies.</div><div class='x9'>Known from all pages of this site</div>"
    "<main><h1>Title {n}</h1><p>First&nbsp;  paragraph {n} &amp; more<br>second line<p>Unclosed {n}"
    "<ul><li>one {n}<li>two {n}</ul><aside>Related: {n}</aside><form><input><button>Send {n}</button></form></main>"
    "<section id='comments'><p>Reader {n} says</p></section><footer>&copy; Site</footer></body></html>"
)


def test_page_text(spark):
    pages = [(n, f"https://user@Site.example:80/p/{n}?q=1", PAGE.format(n=n)) for n in range(12)]
    pages += [(20, None, None), (21, "", ""), (22, "not a url", "<p>cut off <b>here &am"), (23, "http://solo.example/", "<!-- <p>no</p> --><p>a</p>\n b \t c<div>d</div>")]
    pages += [(24, "http://solo.example/2", "plain words, no markup"), (24, "http://solo.example/2", "plain words, no markup")]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, host string, page int")
    rows = templates.extract_main_text(df, least=5, share=0.5).collect()
    got = {r.page_id: r for r in rows}
    for n in range(12):
        assert got[n].text == f"Title {n}\n\nFirst paragraph {n} & more second line\n\nUnclosed {n}\n\none {n}\n\ntwo {n}"
        assert got[n].n_chars == len(got[n].text)
    assert (got[20].text, got[20].url, got[21].text) == ("", None, "")
    assert got[22].text == "cut off here &am" and got[23].text == "a\n\nb c\n\nd" and got[24].text == "plain words, no markup"
    assert len(rows) == len(pages)


def test_recurring_subtrees_go_without_names(spark):
    """A box that no rule names is deleted where it recurs on its host, and kept elsewhere."""
    page = "<body><div class='q1'>Same box</div><p>Own text {n}</p></body>"
    pages = [(n, "http://many.example/", page.format(n=n)) for n in range(10)] + [(99, "http://few.example/", page.format(n=99))]
    got = {r.page_id: r.text for r in templates.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[3] == "Own text 3" and got[99] == "Same box\n\nOwn text 99"


def test_copies_of_one_article_stay(spark):
    pages = [(n, "http://copies.example/", "<article><p>The same article</p></article><footer>f</footer>") for n in range(20)]
    got = templates.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {"The same article"}


MENU = "<nav><ul>{links}</ul></nav><div class='ad'>Buy {n} now.</div>"
STORY = "<article><h1>Title {n}</h1><div class='share-price'>Up {n}</div><p>{text}</article>"


def test_menus_that_differ_go_by_their_shape(spark):
    """Menus, adverts and footers of other words on every page; paragraphs of the same shape stay."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    pages, wanted = [], {}
    for n in range(40):
        links = "".join(f"<li><a href='/{word()}'>{word()}</a></li>" for _ in range(rng.randint(2, 30)))
        paragraphs = [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 6))]
        body = "".join(f"<div class='text'><p>{p}</p></div>" for p in paragraphs)
        pages.append((n, f"http://plain.example/{n}", MENU.format(links=links, n=n) + f"<h1>{word()}</h1>" + body + f"<footer>&copy; {word()} {n}</footer>"))
        wanted[n] = [*paragraphs]
    rows = {r.page_id: r for r in templates.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(r.text.split("\n\n")[1:] == wanted[n] and r.n_deleted == 3 for n, r in rows.items())


def brute_template(pages, share, most, least, short):
    """Sets of one host's recurring subtrees, counted in plain lists."""
    trees = [templates.parse(p) for p in pages]
    elements = [templates.measure(t) for t in trees]
    exact, shapes = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0])
    sizes = {}
    for own in elements:
        exact.update({e.hash for e in own if e.size})
        sizes.update({e.hash: e.size for e in own})
        for shape in {e.shape for e in own if e.size and e.tag in templates.CONTAINERS and not e.holds_main}:
            like = [e for e in own if e.size and e.shape == shape and e.tag in templates.CONTAINERS and not e.holds_main]
            for k, v in enumerate((1, sum(e.size for e in like), sum(e.links for e in like))):
                shapes[shape][k] += v
    n, mean = len(pages), sum(t.size for t in trees) / len(pages)
    if n < least:
        return None
    many = {h for h, c in exact.items() if c >= least and c >= share * n and sizes[h] * 2 < mean}
    plain = {h for h, (c, size, links) in shapes.items() if c >= least and c >= most * n and size * 2 < mean * c and (links * 2 >= size or size <= short * c)}
    return templates.Template(many, {h for h in many if exact[h] >= most * n}, plain)


@pytest.mark.parametrize("seed", range(3))
def test_templates_equal_brute_force(spark, seed):
    """Hosts of few and of many pages, boxes on some of them, at the borders of the shares too."""
    rng = random.Random(seed)
    hosts = {"one.example": 1, "four.example": 4, "five.example": 5, "twenty.example": 20, "hundred.example": 100}
    pages = []
    for host, size in hosts.items():
        for n in range(size):
            parts = [f"<div class='box{k}'>box {k} of {host}</div>" for k, on in enumerate((1, 2, 5, 10, size // 2)) if n < on]
            parts += [f"<ul class='m'><li><a href='/{rng.random()}'>{rng.randint(0, 99)}</a></li></ul>"] * (n % 2)
            parts += [f"<section><p>{rng.randint(0, 9)} {'word ' * rng.randint(1, 80)}</p></section>", STORY.format(n=n, text="story " * rng.randint(0, 90))]
            rng.shuffle(parts)
            pages.append((len(pages), f"https://{host}/{n}", "<body>" + "".join(parts) + "<form>Send</form></body>"))
    got = {r.page_id: (r.text, r.n_deleted) for r in templates.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)).collect()}
    for host in hosts:
        own = [(k, p) for k, u, p in pages if f"//{host}/" in u]
        for k, page in own:
            template = brute_template([p for _, p in own], 0.05, 0.5, 5, 200)
            text, deleted = templates.main_text(page, template)
            assert got[k] == (text, None if template is None else deleted) and "Up" in text


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    long = "<article>" + "<p>long text of a page</p>" * 40_000 + "</article>"
    pages = [(n, "http://odd.example/", "<nav><a href='/'>Home</a></nav>" + body) for n, body in enumerate([deep, long, "<p>x", "", "<p>y</p>", "<p>z</p>"])]
    got = {r.page_id: r.text for r in templates.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[0] == "deep" and got[1].count("long text of a page") == 40_000 and [got[n] for n in (2, 4, 5)] == ["x", "y", "z"]


def test_no_pages(spark):
    assert templates.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def brute_contamination(docs, items, size):
    windows = collections.defaultdict(set)
    for name, text in items:
        words = fold_words((text or "").encode())
        width = min(size, len(words))
        for k in range(len(words) - width + 1 if width else 0):
            windows[tuple(words[k : k + width])].add("" if name is None else str(name))
    out = []
    for doc, text in docs:
        words, hit, found = fold_words((text or "").encode()), set(), set()
        for width in {len(w) for w in windows}:
            for k in range(len(words) - width + 1):
                if names := windows.get(tuple(words[k : k + width])):
                    found |= names
                    hit |= set(range(k, k + width))
        names = ",".join(sorted(found))
        out.append((doc, len(words), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)))
    return out


@pytest.mark.parametrize("most_words", [500_000, 20])
def test_contamination(spark, odd_docs, most_words):
    draw = random.Random(4)
    say = lambda n: " ".join(draw.choice(["ab", "cd", "ef", "gh"]) for _ in range(n))
    items = [(k, say(draw.randrange(3, 30))) for k in range(15)] + [(100, None), (101, ""), (102, "w3 harbour3"), (None, "w5 harbour5 w6"), (7, say(6)), (103, "never seen words")]
    docs = [(k, say(draw.randrange(0, 60)) + " " + draw.choice(items)[1].__str__() + ". " + say(5)) for k in range(60)] + [(r.doc_id, r.text) for r in odd_docs.collect()]
    index = decontaminate.build_index(spark.createDataFrame(docs, "doc_id long, text string"), shard_words=200)
    got = decontaminate.contamination(None, spark.createDataFrame(items, "item_id long, text string"), size=5, index=index, most_words=most_words).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted([tuple(r)[:6] for r in got], key=key) == sorted(brute_contamination(docs, items, 5), key=key)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "one two extra three four five six"), (3, "one far away from the rest of two three")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "two three four five")], "item_id long, text string")
    exact = {r.doc_id: r.n_items for r in decontaminate.contamination(docs, items).collect()}
    near = {r.doc_id: r.n_items for r in decontaminate.contamination(docs, items, slack=1).collect()}
    assert exact == {1: 1, 2: 0, 3: 0} and near == {1: 1, 2: 1, 3: 0}


def test_no_benchmark_and_no_documents(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated or r.n_hit for r in decontaminate.contamination(odd_docs, none).collect())
    assert decontaminate.contamination(no_docs, none).count() == 0


def brute_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    counts = collections.Counter(windows)
    inside = {k + j for k, w in enumerate(windows) if counts[w] > 1 for j in range(5)}
    lines = [ln for ln in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", ln)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_rule_statistics(spark, odd_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()] + [(50, "a b c d e a b c d e f\n\n a b\n a b"), (51, "ein | zwei <b>\n\x0b\nzwei")]
    got = quality.rule_stats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted([tuple(r)[:6] for r in got], key=key) == sorted([(i, *brute_stats(t)) for i, t in docs], key=key)


def test_quality_verdicts(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = quality.quality_verdicts(docs, labels).join(labels, "doc_id").collect()
    good, bad = [r.kept for r in rows if r.quality == 1 and not r.base_failed], [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.2 * len(bad)
    assert all(not r.kept for r in rows if r.base_failed)


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(5, None), (None, 1), (6, 1), (6, 0)], "doc_id long, quality int")
    rows = quality.quality_verdicts(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(r.base_failed for r in rows if r.n_words < 10)
    assert quality.quality_verdicts(no_docs, labels.limit(0)).count() == 0


def test_forest_finds_the_odd_row():
    draw = np.random.default_rng(1)
    rows = np.vstack([draw.normal(0, 1, (500, 4)), [[9, 9, 9, 9]]])
    scores = quality.Forest(rows, 100, 256).scores(rows)
    assert scores.argmax() == 500 and quality.Forest(rows[:1], 10, 256).scores(rows).max() == 0


def test_licences(spark, odd_docs, no_docs):
    texts = {
        1: "Released under the MIT License. Also under-the MIT license", 2: "Apache License, Version 2.0; CC BY-NC 4.0", 3: "licensed under the GNU General Public License version 3",
        4: "SPDX-License-Identifier: BSD-3-Clause", 5: "an understanding of the mit licenses", 6: "Permission is hereby granted, free of charge", 7: "cc by nc cc by nc",
    }
    got = {r.doc_id: r for r in licences.scan_licences(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (2, 1, 6, "mit") and got[1].labels == "mit"
    assert got[2].base_labels == "apache-2,cc-by-nc" and got[2].n_base == 2
    assert (got[3].labels, got[3].n_base, got[3].first_word) == ("gpl-3", 0, None) and got[4].labels == "bsd-3"
    assert (got[5].labels, got[5].score) == ("", 0.0) and got[6].labels == "permissive" and got[7].n_base == 2
    assert len(licences.rules()) > 300
    rows = licences.scan_licences(odd_docs).collect()
    assert len(rows) == odd_docs.count() and licences.scan_licences(no_docs).count() == 0


def test_suppression():
    _, found = licences.detections(b"licensed under the apache license version 2 0 license")
    assert [(r.label, r.priority) for _, _, r in found] == []  # the base phrase lies in the wider rule's way
    base, found = licences.detections(b"licensed under the gnu general public license version 3 license mit license")
    assert not base and [r.label for _, _, r in found] == ["gpl-3", "mit"]


def brute_places(text):
    words = fold_words((text or "").encode())
    places = []
    for phrase in licences.BASE:
        parts = [w.encode() for w in phrase.split()]
        places += [k for k in range(len(words)) if words[k : k + len(parts)] == parts]
    return len(words), len(places), min(places, default=None), max(places, default=None)


def test_base_phrases_of_all_documents(spark, sf_dir):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    rows = registered.op7_licence_scan(spark, sf_dir).collect()
    assert all((r.n_words, r.n_base, r.first_word, r.last_word) == brute_places(texts[r.doc_id]) for r in rows) and len(rows) == len(texts)


def test_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir.replace("0.001", "0.01"), "documents")
    labels = table(spark, sf_dir.replace("0.001", "0.01"), "labels")
    rows = toxicity.toxicity_scores(docs, labels, trees=8).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    toxic, clean = [r.score for r in rows if r.toxic and r.held_out], [r.score for r in rows if not r.toxic and r.held_out]
    better = np.mean([(t > c) + 0.5 * (t == c) for t in toxic for c in clean])
    assert better > 0.7 and np.mean([c >= 0.5 for c in clean]) < 0.05


def test_toxicity_without_labels(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity_scores(odd_docs, none).collect()} == {0.0}
    one = spark.createDataFrame([(n, 1) for n in range(10)] + [(3, None), (None, 0)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity_scores(odd_docs, one).collect()} == {1.0}
    assert toxicity.toxicity_scores(no_docs, none).count() == 0


def test_features():
    lexicon, stems = frozenset({b"idiot"}), frozenset({b"vejut"})
    values = dict(zip(toxicity.FEATURES, toxicity.features("You IDIOT! an 1d1ot, vejutar".encode(), lexicon, stems)))
    assert values["lexicon"] == 1 / 5 and values["stems"] == 1 / 5 and values["near_second_person"] > 0 and values["shouted"] > 0
    assert set(toxicity.features(b"", lexicon, stems)) == {0.0}


def test_pipeline(spark, sf_dir):
    """Stages beside brute force; every stage but the last returns the columns of documents."""
    import corpus_pipeline
    from tests.llm.test_duplicates import brute_removal, linked, shingles

    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.scratch_path(spark, "test-stage")
        stage(spark, frames[-1], sf_dir).write.parquet(out)
        frames.append(spark.read.parquet(out))
        assert name == corpus_pipeline.STAGES[-1][0] or frames[-1].columns == columns
    kept = {r.doc_id for r in quality.quality_verdicts(docs, table(spark, sf_dir, "labels")).where("kept").collect()}
    texts = {r.doc_id: r.text for r in frames[1].collect()}
    assert set(texts) == kept
    ids = sorted(texts)
    roots = linked([shingles(texts[i], 4) for i in ids], 85)
    stay = {ids[r] for r in roots}
    assert {r.doc_id for r in frames[2].collect()} == stay
    ids = sorted(stay)
    want = dict(zip(ids, brute_removal([texts[i].encode() for i in ids], 400)))
    after = {r.doc_id: r for r in frames[3].collect()}
    assert set(after) == stay and all(len(after[i].text.encode()) <= want[i][0] - want[i][1] <= len(after[i].text.encode()) + 3 * want[i][2] + 3 for i in ids)
    assert all(r.n_chars == len(r.text) for r in after.values())
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    leaks = {r[0] for r in brute_contamination([(i, r.text) for i, r in after.items()], items, 13) if r[5]}
    assert {r.doc_id for r in frames[4].collect()} == stay - leaks
    last = frames[5].collect()
    assert {r.doc_id for r in last} == stay - leaks and all(len(r.ids) == r.n_tokens for r in last)


def test_entry_lists_every_operator():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names


def test_pipeline_with_further_columns(spark, sf_dir):
    import corpus_pipeline

    docs = table(spark, sf_dir, "documents").limit(60).withColumn("_id", F.lit(1)).withColumn("kept", F.lit("x")).withColumn("digest", F.lit(None).cast("string"))
    docs = docs.union(docs.limit(3)).union(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit(None).cast("string")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.scratch_path(spark, "test-wide")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    assert {"_id", "kept", "digest"} <= set(docs.columns)


def test_pipeline_judges_rows_of_one_id_apart(spark, sf_dir):
    """Junk, near copies and leaks among rows of a null or repeated id take no other row with them, and leave one copy."""
    import corpus_pipeline

    draw = random.Random(23)
    docs = table(spark, sf_dir, "documents")
    sound = [r.text for r in corpus_pipeline.quality_rules(spark, docs, sf_dir).where("length(text) between 600 and 3000").orderBy("doc_id").limit(6).collect()]
    rows = [(i, t) for i in (None, 77) for t in (sound[0], sound[1], "junk " * 50)] + [(None, sound[2]), (5, sound[3])]
    quality_in = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {(r.doc_id, r.text) for r in corpus_pipeline.quality_rules(spark, quality_in.unionByName(docs.select("doc_id", "text")), sf_dir).collect()}
    assert {(i, t) for i, t in rows if t != "junk " * 50} <= kept and not any(t == "junk " * 50 for _, t in kept)

    base = [f"w{draw.randrange(10**6)}" for _ in range(100)]
    near = [" ".join([*base[:k], "edit", *base[k + 1 :]]) for k in (0, 99, 98)]
    others = [" ".join(f"v{draw.randrange(10**6)}" for _ in range(60)) for _ in range(4)]
    rows = [(None, near[0]), (None, near[1]), (None, others[0]), (None, others[0]), (8, others[1]), (8, others[2]), (8, others[3]), (9, others[3])]
    left = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir).collect()]
    assert len(left) == 5 and sum(t in near for _, t in left) == 1
    assert {(None, others[0]), (8, others[1]), (8, others[2]), (8, others[3])} < set(left)
    rows = [(4, near[0]), (4, near[1]), (None, near[2])]
    left = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir).collect()
    assert len(left) == 1 and left[0].doc_id == 4

    item = next(r.text for r in table(spark, sf_dir, "benchmark").collect() if len(fold_words(r.text.encode())) > 20)
    rows = [(i, t) for i in (None, 6) for t in (item, others[0])]
    left = corpus_pipeline.benchmark_leaks(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir).collect()
    assert {(r.doc_id, r.text) for r in left} == {(None, others[0]), (6, others[0])}


def alternatives(pattern):
    """All texts that a pattern of groups, alternatives, optional parts and sets of characters matches."""
    import itertools
    from re import _parser as parser

    def expand(node):
        out = [""]
        for kind, value in node:
            name = str(kind)
            if name == "LITERAL":
                parts = [chr(value)]
            elif name == "IN":
                parts = [c for op, v in value for c in ([chr(v)] if str(op) == "LITERAL" else [chr(v[0]), chr(v[1])])]
            elif name == "BRANCH":
                parts = [t for branch in value[1] for t in expand(branch)]
            elif name == "SUBPATTERN":
                parts = expand(value[3])
            else:
                assert name == "MAX_REPEAT" and value[:2] == (0, 1), name
                parts = ["", *expand(value[2])]
            out = list(dict.fromkeys(a + b for a, b in itertools.product(out, parts)))
        return out

    return expand(parser.parse(pattern))


def test_every_alternative_holds_its_keywords():
    for label, name, keyword in licences.LICENCES:
        assert all(keyword in text for text in alternatives(name)), label
    for wording, _, _, keyword in licences.WORDINGS:
        assert all(keyword in text for text in alternatives(wording.replace("{}", "name"))), wording
    for label, pattern, _, keyword in licences.NOTICES:
        assert all(keyword in text for text in alternatives(pattern)), label
    assert [r.label for _, _, r in licences.detections(b"licensed under the zope public license")[1]] == ["zope"]

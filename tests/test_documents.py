"""JSON accuracy, page cards, notebook search and text extraction."""

import json

import pytest
from pyspark.sql import functions as F

from tallybook.operators import documents as docs
from tallybook.plans.documents import document_pairs
from tallybook.sources.tables import Tables

ACTUAL = {"vessel": "Petrel", "crew": {"master": "Okafor", "hands": 9}, "ports": ["Bergen", "Leith", "Hull"], "laden": True}
PREDICTED = {
    "vessel": "Petrel", "crew": {"master": "Okafor", "hands": 11}, "ports": ["Bergen", "Hull", "Hull"], "laden": True,
    "flag": "NO",
}


def accuracy(spark, actual, predicted):
    row = spark.createDataFrame([(1, json.dumps(actual), json.dumps(predicted))], "id int, a string, p string")
    r = docs.json_accuracy(row, "id", "a", "p").first()
    return r.total_fields, r.additions, r.deletions, r.modifications, r.score


@pytest.mark.parametrize(
    "actual, predicted, expected",
    [
        (ACTUAL, PREDICTED, (7, 1, 0, 2, 0.5714)),
        (ACTUAL, ACTUAL, (7, 0, 0, 0, 1.0)),
        ({}, {"a": 1}, (0, 1, 0, 0, 1.0)),
        ({"a": {"b": 1, "c": 2}}, {}, (2, 0, 2, 0, 0.0)),
        ({"x__old": 1, "y": 2}, {"x__old": 1, "y": 2}, (1, 0, 0, 0, 1.0)),
        ({"a": {"b": 1}}, {"a": "text"}, (1, 0, 0, 1, 0.0)),
        ({"a": {}}, {"a": []}, (0, 0, 0, 1, 1.0)),
        ({"a": 30}, {"a": "30"}, (1, 0, 0, 1, 0.0)),
        ({"a": None}, {"a": None}, (1, 0, 0, 0, 1.0)),
        ({"a": 1}, {"a": 1, "m": {"b__x": 1, "c": [1, {"d": 2}]}}, (1, 2, 0, 0, 0.0)),
        ({"a/b": 1, "a": {"b": 1}}, {"a/b": 2, "a": {"b": 1}}, (2, 0, 0, 1, 0.5)),
        ([1, 2, 3], [1, 2], (3, 0, 1, 0, 0.6667)),
        ([1, 2, 3, 4], [0, 1, 2, 3, 4], (4, 1, 0, 4, 0.0)),
    ],
)
def test_json_accuracy(spark, actual, predicted, expected):
    assert accuracy(spark, actual, predicted) == expected


def test_malformed_and_deep(spark):
    broken = spark.createDataFrame([(1, "{oops")], "id int, j string")
    assert docs.field_count(broken, "id", "j").first().total_fields in (None, -1)
    deep = "1"
    for _ in range(40):
        deep = f'{{"a": {deep}, "b": 2}}'
    assert docs.field_count(spark.createDataFrame([(1, deep)], "id int, j string"), "id", "j").first().total_fields == 41


def test_many_changes(spark):
    actual = {f"k{n}": n for n in range(1500)}
    predicted = {f"k{n}": n + 1 for n in range(1500)} | {f"new{n}": n for n in range(1500)}
    assert accuracy(spark, actual, predicted)[:4] == (1500, 1500, 0, 1500)


def test_single_quoted_updates_file(spark, tmp_path):
    (tmp_path / "u.json").write_text(
        "{'publicationDate': 'May 2024', 'updates': [{'workload': 'A', 'item': 'x', 'status': 'New', 'tasks': ['t1', 't2']},\n"
        " {'workload': 'A', 'status': 'Update', 'tasks': []}, {'workload': 'B', 'status': 'New'}]}"
    )
    flat = docs.flatten_updates(docs.read_updates(spark, str(tmp_path)))
    assert flat.count() == 3 and flat.filter(F.col("publicationDate") == "May 2024").count() == 3
    table = {r.workload: (r.New, r.Update) for r in docs.crosstab(flat, "workload", "status", ["New", "Update"]).collect()}
    assert table == {"A": (1, 1), "B": (1, 0)}
    others = {r.workload: r.other for r in docs.crosstab(flat, "workload", "status", ["New"]).collect()}
    assert others == {"A": 1, "B": 0}


def test_keyword_files(spark, tmp_path):
    folder = tmp_path / "deep" / "er"
    folder.mkdir(parents=True)
    cell = {"cell_type": "code", "source": ["import needle\n", "x = 1"]}
    (folder / "yes.ipynb").write_text(json.dumps({"cells": [cell]}, indent=1))
    (tmp_path / "text.ipynb").write_text(json.dumps({"cells": [{"cell_type": "markdown", "source": "needle"}]}))
    (tmp_path / "string.ipynb").write_text(json.dumps({"cells": [{"cell_type": "code", "source": "a needle"}]}))
    (tmp_path / "broken.ipynb").write_text("{not json")
    (tmp_path / "other.txt").write_text("needle")
    found = {r.path.rsplit("/", 1)[1] for r in docs.keyword_files(spark, str(tmp_path), "needle").collect()}
    assert found == {"yes.ipynb", "string.ipynb"}


def test_html_cards(spark):
    card = (
        '<div class="card"><h2 class="title"> Product A </h2><a href="/idea/?id=42">Better &amp; faster</a>'
        '<a class="who" href="/u?user=77"></a><b class="votes"><i>12</i></b></div>'
    )
    pages = spark.createDataFrame([(1, f"<body>{card}<div class=\"card\"><h2 class=\"title\">B</h2></div></body>")], "page_id int, html string")
    rows = docs.html_cards(
        pages, ["page_id"], "html", r'(?s)<div class="card">(.*?)</div>',
        {"product_name": r'(?s)<h2 class="title">(.*?)</h2>', "idea": r"(?s)<a [^>]*>(.*?)</a>", "votes": r"(?s)<b [^>]*>(.*?)</b>"},
        {"idea_id": (r'<a href="([^"]*)"', ("/", "=")), "user_id": (r'class="who" href="([^"]*)"', ("=",))},
    ).orderBy("card_number").collect()
    assert rows[0].asDict() == {
        "page_id": 1, "card_number": 0, "product_name": "Product A", "idea": "Better & faster", "votes": "12", "idea_id": "42", "user_id": "77",
        "date": None, "state": None, "like_count": None, "description": None,
    }
    assert (rows[1].product_name, rows[1].idea, rows[1].idea_id) == ("B", None, None)


def test_character_references(spark):
    marked = [("caf&#233;&nbsp;&#x20AC;5 &amp;lt; &middot; <i>x</i>",), ("no reference & more",), ("&#0; &#99999999;",)]
    got = [r[0] for r in spark.createDataFrame(marked, "t string").select(docs.visible_text(F.col("t"))).collect()]
    assert got[:2] == ["caf\u00e9\xa0\u20ac5 &lt; \xb7 x", "no reference & more"] and got[2].endswith("&#99999999;")


def test_connection_parts(spark):
    rows = spark.createDataFrame([('let s = Sql.Database("srv", "db") in s',), ("nothing",)], "t string")
    assert [tuple(r) for r in rows.select(*docs.connection_parts("t")).collect()] == [("srv", "db"), (None, None)]


def test_every_entry_of_a_page_is_a_card(spark, tmp_path):
    from tallybook import registry

    html = (
        '<html lang="no"><head><title>Quay</title></head><body><h1>Berths</h1>'
        '<ul><li><a href="/b/one">North</a></li><li>South &amp; east</li></ul><li><a href="/x?id=3">Mole</a></li></body></html>'
    )
    spark.createDataFrame([(1, "u", html), (2, "u", "<html></html>")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    rows = registry.all_queries()["doc_html_entries"](spark, str(tmp_path)).orderBy("page_id", "card_number").collect()
    assert [(r.page_id, r.card_number, r.votes, r.idea_id) for r in rows] == [(1, 0, "North", "one"), (1, 1, "South & east", None), (1, 2, "Mole", "3")]
    assert {(r.product_name, r.idea, r.date) for r in rows} == {("Quay", "Berths", "no")}


def test_pairs_of_one_row_group_reach_all_tasks(spark, tmp_path):
    """Customers of a single file part are compared in many tasks, each pair once."""
    people = [(k, f"Customer#{k}", k / 4, "BUILDING", k % 25) for k in range(200)] + [(None, None, None, None, None), (3, "Customer#3", 0.75, "BUILDING", 3)]
    rows = spark.createDataFrame(people, "c_custkey long, c_name string, c_acctbal double, c_mktsegment string, c_nationkey int")
    rows.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    pairs = document_pairs(Tables(spark, str(tmp_path)))
    assert pairs.select(F.spark_partition_id().alias("part")).distinct().count() > 1
    found = docs.json_diff(pairs, "doc_id", "actual", "predicted").collect()
    assert sorted((r.doc_id for r in found), key=str) == sorted((p[0] for p in people), key=str)
    assert all(r.total_fields == 12 and (r.additions, r.deletions, r.modifications) == (0, 0, 0) for r in found if r.doc_id is not None and r.doc_id % 7 == 0)

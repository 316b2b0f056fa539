"""Element trees and selectors beside a brute-force tree; page cards."""

import random

import pytest

from tallybook.functions.markup import Selector, Tree
from tallybook.operators import pages as pg

CLASSES, BLOCKS, INLINE = ["a", "b", "c"], ["div", "ul", "table", "p"], ["span", "b", "img"]


class Node:
    def __init__(self, tag, parent=None):
        self.tag, self.parent, self.kids, self.attrs = tag, parent, [], {}

    def elements(self):
        yield self
        for kid in self.kids:
            if isinstance(kid, Node):
                yield from kid.elements()

    def text(self):
        return "".join(k if isinstance(k, str) else k.text() for k in self.kids)

    def siblings(self):
        return [k for k in self.parent.kids if isinstance(k, Node)] if self.parent else [self]


def grow(rng, node, depth):
    """A random subtree with the nestings that the standard allows."""
    for _ in range(rng.randint(0, 4)):
        if node.tag == "ul":
            tag = "li"
        elif node.tag == "table":
            tag = "tr"
        elif node.tag == "tr":
            tag = "td"
        elif node.tag in ("p", "span", "b"):
            tag = rng.choice(INLINE)
        else:
            tag = rng.choice(BLOCKS + INLINE)
        kid = Node(tag, node)
        if rng.random() < 0.6:
            kid.attrs["class"] = " ".join(rng.sample(CLASSES, rng.randint(1, 2)))
        if rng.random() < 0.3:
            kid.attrs["data-x"] = rng.choice(["one", "one-two", "two one"])
        node.kids.append(kid)
        if tag != "img" and depth:
            grow(rng, kid, depth - 1)
        if node.tag not in ("ul", "table", "tr") and rng.random() < 0.5:
            node.kids.append(rng.choice(["t1 ", "t2", "x < 3 "]))
        if tag not in ("ul", "table", "tr", "img") and rng.random() < 0.5:
            kid.kids.append(f"w{rng.randint(0, 99)} ")


def markup(rng, node):
    attrs = "".join(f' {k}="{v}"' if rng.random() < 0.7 else f" {k.upper()}='{v}'" for k, v in node.attrs.items())
    inside = []
    for place, kid in enumerate(node.kids):
        if isinstance(kid, str):
            inside.append(kid.replace("<", "&lt;"))
            continue
        following = node.kids[place + 1] if place + 1 < len(node.kids) else None
        after = following.tag if isinstance(following, Node) else following
        body = markup(rng, kid)
        droppable = (
            kid.tag in ("li", "tr", "td")
            or kid.tag == "p" and (after in ("p", "div", "ul", "table") or after is None and node.tag in ("div", "li", "td", "body"))
        )
        if kid.tag != "img" and not (droppable and rng.random() < 0.6):
            body += f"</{kid.tag}>"
        inside.append(body + ("<!-- <p> -->" if rng.random() < 0.1 else ""))
    name = node.tag.upper() if rng.random() < 0.2 else node.tag
    return f"<{name}{attrs}>" + "".join(inside)


def has(node, part):
    kind, value = part[0], part[1:]
    places = node.siblings()
    if kind == "t":
        return node.tag == value
    if kind == "c":
        return value in node.attrs.get("class", "").split()
    if kind == "x":
        return node.attrs.get("data-x", "").startswith("one")
    if kind == "n":
        return places.index(node) + 1 == int(value)
    if kind == "l":
        return len(places) - places.index(node) == int(value)
    return (places.index(node) + 1) % 2 == 1  # "o"


SPELLED = {"t": "{}", "c": ".{}", "x": '[data-x^="one"]', "n": ":nth-child({})", "l": ":nth-last-child({})", "o": ":nth-child(odd)"}


def fits(node, chain):
    """By the definition, over all nodes that a joint may lead to."""
    joint, parts = chain[-1]
    if not all(has(node, p) for p in parts):
        return False
    if len(chain) == 1:
        return True
    places = node.siblings()
    above = []
    up = node.parent
    while up:
        above.append(up)
        up = up.parent
    others = {" ": above, ">": above[:1], "+": places[max(0, places.index(node) - 1) : places.index(node)], "~": places[: places.index(node)]}[joint]
    return any(fits(o, chain[:-1]) for o in others)


def random_chain(rng):
    chain = []
    for step in range(rng.randint(1, 3)):
        parts = [rng.choice(["tdiv", "tp", "tli", "tspan", "tul", "ttd", "tb"])] if rng.random() < 0.6 else []
        parts += rng.sample(["ca", "cb", "x", "n1", "n2", "l1", "o"], rng.randint(0 if parts else 1, 2))
        chain.append((rng.choice([" ", ">", "+", "~"]) if step else "", parts))
    spelled = "".join((f" {j} " if j else "") + "".join(SPELLED[p[0]].format(p[1:]) for p in parts) for j, parts in chain)
    return chain, spelled


@pytest.mark.parametrize("seed", range(40))
def test_selectors_equal_brute_force(seed):
    rng = random.Random(seed)
    root = Node("html")
    body = Node("body", root)
    root.kids.append(body)
    grow(rng, body, 5)
    nodes = list(root.elements())
    tree = Tree(markup(rng, body))
    assert tree.tag == [n.tag for n in nodes]
    assert [tree.text(i) for i in range(len(nodes))] == [n.text() for n in nodes]
    for _ in range(60):
        chain, spelled = random_chain(rng)
        assert list(tree.select(Selector(spelled), and_itself=True)) == [i for i, n in enumerate(nodes) if fits(n, chain)], spelled


def texts(tree, selector):
    return [tree.text(i) for i in tree.select(Selector(selector))]


def test_nested_entries_and_missing_ends():
    tree = Tree("<UL><LI>one<ul><li>two<li>three</ul>four<li>five</UL><p>six<p>seven<div>eight</p></div><td>nine")
    assert texts(tree, "li") == ["onetwothreefour", "two", "three", "five"]
    assert texts(tree, "ul > li > ul > li:last-child") == ["three"] and texts(tree, "p") == ["six", "seven"]
    assert texts(tree, "div") == ["eight"] and texts(tree, "td") == ["nine"]


def test_odd_markup():
    tree = Tree("""<p title='a>b' class="x">1</p><script>var t = "</p><li>";</script><title>A <b> &amp; c</title><!-- <li> --><p title="open>2</p><br/></br>end""")
    assert texts(tree, "title") == ["A <b> & c"] and texts(tree, "li") == [] and texts(tree, "script") == [""]
    assert tree.attributes(next(tree.select(Selector("p"))))["title"] == "a>b"
    assert Tree("").tag == ["html"] and Tree("<").text(0) == "<" and Tree("<!-- x").comment(0) == " x"
    assert texts(Tree(r'<i class="tag--green">y</i>'), r".tag\-\-green, B") == ["y"]
    assert Tree("<div>" * 5000 + "x").text(5000) == "x"


@pytest.mark.parametrize("wrong", ["", "a >", "a,,b", "a:hover", "p[", "li:nth-child(x)", "a b$"])
def test_wrong_selectors(wrong):
    with pytest.raises(ValueError):
        Selector(wrong)


def test_cards(spark):
    card = (
        '<div class="card pad"><h2 class="t big"> Keel &amp; mast </h2><p class="head"><A href="/idea/?id=42">Better</A></p><a class="who" href="/u?user=77"></a>'
        '<b class="votes"><i>12</i></b><div class="card"><h2 class="t">inner</div></div>'
    )
    pages = spark.createDataFrame([(1, card), (2, None), (3, "<p>no card"), (4, "")], "page_id int, source string")
    fields = {
        "product_name": pg.text_of("h2.t"), "idea": pg.text_of(".head a"), "votes": pg.text_of(".votes *"),
        "idea_id": pg.attribute_of(".head > A:nth-child(1):nth-last-child(1)", "href", "/", "="), "user_id": pg.attribute_of(".who", "href", "="),
    }
    rows = pg.select_cards(pages, ["page_id"], "source", "div.card", fields).orderBy("card_number").collect()
    assert [(r.page_id, r.card_number, r.product_name, r.idea, r.votes, r.idea_id, r.user_id, r.state) for r in rows] == [
        (1, 0, "Keel & mast", "Better", "12", "42", "77", None), (1, 1, "inner", None, None, None, None, None),
    ]


def test_table_function_in_sql(spark):
    pg.register(spark)
    found = spark.sql("SELECT e.* FROM VALUES ('<ol><li id=x>1<li>2</ol>'), (NULL) AS p(html), LATERAL select_elements(html, 'ol > li') e ORDER BY place").collect()
    assert [(r.place, r.tag, r.text, r.attributes) for r in found] == [(0, "li", "1", {"id": "x"}), (1, "li", "2", {})]

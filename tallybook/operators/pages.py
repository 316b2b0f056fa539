"""Page cards by CSS selectors, as table functions over parsed pages."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions.markup import Selector, Tree
from tallybook.operators.documents import CARD_FIELDS

#: A field: selector inside its card (empty: the card itself), what to take ("text", "comment" or "@attribute"), and the signs an id follows.
Field = tuple[str, str, tuple[str, ...]]


def text_of(selector: str) -> Field:
    return selector, "text", ()


def attribute_of(selector: str, name: str, *after: str) -> Field:
    return selector, f"@{name}", after


def comment_of(selector: str = "") -> Field:
    return selector, "comment", ()


def taken(tree: Tree, within: int, selector: Selector | None, what: str, after: tuple[str, ...]) -> str | None:
    """Field of the first element that matches, white space at its ends removed; None without one."""
    own = within if selector is None else next(tree.select(selector, within), None)
    if own is None:
        return None
    value = tree.text(own) if what == "text" else tree.comment(own) if what == "comment" else tree.attributes(own).get(what[1:])
    if value is None:
        return None
    value = value.strip()
    for sign in after:
        value = value.rsplit(sign, 1)[-1]
    return value


def cards_function(card: str, fields: dict[str, Field], page_fields: dict[str, Field] | None = None):
    """Table function from a page's HTML to its cards: card_number and one text column per field."""
    ready = {n: (Selector(s) if s else None, what, after) for n, (s, what, after) in fields.items()}
    whole = {n: (Selector(s) if s else None, what, after) for n, (s, what, after) in (page_fields or {}).items()}
    wanted = Selector(card)

    class Cards:
        def eval(self, source: str) -> Iterator[tuple]:
            if source is None:
                return
            tree = Tree(source)
            cards = list(tree.select(wanted, and_itself=True))
            page = [taken(tree, 0, *field) for field in whole.values()] if cards else []
            for number, own in enumerate(cards):
                yield number, *(taken(tree, own, *field) for field in ready.values()), *page

    columns = "".join(f", {name} string" for name in [*ready, *whole])
    return F.udtf(Cards, returnType=f"card_number int{columns}")


def select_cards(pages: DataFrame, keep: list[str], html_col: str, card: str, fields: dict[str, Field], page_fields: dict[str, Field] | None = None) -> DataFrame:
    """Elements that match ``card`` as rows, numbered in page order, with the card fields as columns.

    Each page is parsed once and in its own row. Cards may lie in one another. ``page_fields`` are
    those of the whole page, repeated on its cards. Fields that are not asked for are NULL; pages
    without cards, and NULL pages, give no rows.
    """
    found = pages.lateralJoin(cards_function(card, fields, page_fields)(F.col(html_col).outer()))
    named = {*fields, *(page_fields or {})}
    return found.select(*keep, "card_number", *[F.col(n) if n in named else F.lit(None).cast("string").alias(n) for n in CARD_FIELDS])


class SelectElements:
    """``select_elements(html, selector)``: place, tag, text and attributes of all matching elements."""

    def __init__(self) -> None:
        self.known: dict[str, Selector] = {}

    def eval(self, source: str, selector: str) -> Iterator[tuple]:
        if source is None or selector is None:
            return
        wanted = self.known.setdefault(selector, None) or Selector(selector)
        self.known[selector] = wanted
        tree = Tree(source)
        for place, own in enumerate(tree.select(wanted, and_itself=True)):
            yield place, tree.tag[own], tree.text(own).strip(), tree.attributes(own)


def register(spark: SparkSession, name: str = "select_elements") -> None:
    """Make the selector a SQL table function: ``SELECT page_id, e.* FROM pages, LATERAL select_elements(html, 'ul > li') e``."""
    spark.udtf.register(name, F.udtf(SelectElements, returnType="place int, tag string, text string, attributes map<string,string>"))

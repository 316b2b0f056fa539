"""HTML as a tree of elements, and the CSS selectors that find them."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW, TEXT_ONLY = frozenset("script style".split()), frozenset("title textarea".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split()
)
PARAGRAPH_SCOPE = frozenset("button caption html marquee object table td template th".split())
LIST_SCOPE = PARAGRAPH_SCOPE | frozenset("article aside blockquote body details dl fieldset figure footer form header main menu nav ol section select ul tr tbody".split())
TABLE_SCOPE = frozenset("html table template".split())
#: What the start of an element ends when it is still open, and the elements beyond which it does not look.
ENDS = {
    "li": (frozenset(["li"]), LIST_SCOPE),
    "dt": (frozenset(["dt", "dd"]), LIST_SCOPE),
    "dd": (frozenset(["dt", "dd"]), LIST_SCOPE),
    "option": (frozenset(["option"]), LIST_SCOPE),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select", "html"])),
    "td": (frozenset(["td", "th"]), TABLE_SCOPE | {"tr"}),
    "th": (frozenset(["td", "th"]), TABLE_SCOPE | {"tr"}),
    "tr": (frozenset(["tr"]), TABLE_SCOPE | {"tbody", "thead", "tfoot"}),
    "tbody": (frozenset(["tbody", "thead", "tfoot"]), TABLE_SCOPE),
    "thead": (frozenset(["tbody", "thead", "tfoot"]), TABLE_SCOPE),
    "tfoot": (frozenset(["tbody", "thead", "tfoot"]), TABLE_SCOPE),
}
TAG = re.compile(
    r"""<!--(?P<comment>.*?)(?:-->|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>[^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>][^\s=/>]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


class Tree:
    """Elements of a page in document order, the root (``html``) first.

    List entries, table parts, options, terms and paragraphs without an end tag end where the
    next one begins, as the standard has it; an end tag also ends what is open inside its
    element, and one without an element is passed over. Formatting left open in a paragraph
    is not taken up again in the next one. A page without an ``html`` tag has a root all the same.
    """

    def __init__(self, source: str):
        self.tag, self.parent, self.last, self.nth = ["html"], [-1], [0], [1]
        self.raw_attrs: list[str] = [""]
        self.children, self.youngest, self.before = [0], [-1], [-1]  # number of children, the last one so far, the sibling before
        self.first_text, self.end_text = [0], [0]
        self.texts: list[str] = []
        self.comments: list[tuple[int, str]] = []  # (element count at its place, text)
        self.by_tag: dict[str, list[int]] = defaultdict(list, html=[0])
        self.seen: dict[int, dict[str, str]] = {}
        self._parse(source)

    def _parse(self, source: str) -> None:
        open_ = [0]
        at, size = 0, len(source)
        while at < size:
            found = TAG.search(source, at)
            start = found.start() if found else size
            if start > at:
                self.texts.append(source[at:start])
            if not found:
                break
            at = found.end()
            if found["comment"] is not None:
                self.comments.append((len(self.tag), found["comment"]))
                continue
            name = (found["name"] or found["name2"] or "").lower()
            if not name:
                continue
            if found["end"] or found["end2"]:
                self._end(open_, name)
                continue
            attrs = found["attrs"] or found["attrs2"] or ""
            if name == "html":
                self.raw_attrs[0] = self.raw_attrs[0] or attrs
                continue
            self._make_room(open_, name)
            own = self._add(name, open_[-1], attrs)
            if name in RAW or name in TEXT_ONLY:
                end = re.compile(rf"</{name}\b", re.I).search(source, at)
                stop = end.start() if end else size
                if name in TEXT_ONLY:
                    self.texts.append(source[at:stop])
                at = stop
                open_.append(own)
            elif name in VOID:
                self._close(own)
            else:
                open_.append(own)
        while open_:
            self._close(open_.pop())

    def _add(self, name: str, parent: int, attrs: str) -> int:
        own = len(self.tag)
        self.children[parent] += 1
        for column, value in (
            (self.tag, name), (self.parent, parent), (self.last, own), (self.nth, self.children[parent]), (self.raw_attrs, attrs),
            (self.children, 0), (self.youngest, -1), (self.before, self.youngest[parent]), (self.first_text, len(self.texts)), (self.end_text, 0),
        ):
            column.append(value)
        self.youngest[parent] = own
        self.by_tag[name].append(own)
        return own

    def _close(self, own: int) -> None:
        self.last[own], self.end_text[own] = len(self.tag) - 1, len(self.texts)

    def _close_nearest(self, open_: list[int], names: frozenset[str], scope: frozenset[str]) -> None:
        for place in range(len(open_) - 1, 0, -1):
            if self.tag[open_[place]] in names:
                while len(open_) > place:
                    self._close(open_.pop())
                return
            if self.tag[open_[place]] in scope:
                return

    def _make_room(self, open_: list[int], name: str) -> None:
        if name in ENDS:
            self._close_nearest(open_, *ENDS[name])
        if name in ENDS_PARAGRAPH:
            self._close_nearest(open_, frozenset(["p"]), PARAGRAPH_SCOPE)

    def _end(self, open_: list[int], name: str) -> None:
        # An end tag does not reach out of a table's cell, but for those of the table itself.
        scope = frozenset() if name in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "body") else frozenset(["td", "th", "table"])
        self._close_nearest(open_, frozenset([name]), scope)

    def attributes(self, own: int) -> dict[str, str]:
        """Names in lower case; the first of a repeated name counts."""
        if own not in self.seen:
            found: dict[str, str] = {}
            for name, double, single, bare in ATTRIBUTE.findall(self.raw_attrs[own]):
                found.setdefault(name.lower(), html.unescape(double or single or bare))
            self.seen[own] = found
        return self.seen[own]

    def text(self, own: int) -> str:
        """All text inside, character references decoded; comments, scripts and styles are none."""
        return html.unescape("".join(self.texts[self.first_text[own] : self.end_text[own]]))

    def comment(self, own: int) -> str | None:
        """The first comment inside."""
        for place, text in self.comments:
            if own < place <= self.last[own] + 1:
                return text
        return None

    def select(self, selector: Selector, within: int = 0, and_itself: bool = False) -> Iterator[int]:
        """Elements inside ``within`` that match, in document order; ancestors outside of it count for the match."""
        low, high = within + (not and_itself), self.last[within]
        wanted = selector.tags
        if wanted is None:
            candidates = range(low, high + 1)
        else:
            places = (self.by_tag.get(t, []) for t in wanted)
            candidates = sorted(i for p in places for i in p[bisect_left(p, low) : bisect_left(p, high + 1)])
        return (i for i in candidates if selector.matches(self, i))


IDENTIFIER = r"(?:[-\w\u0080-\U0010ffff]|\\.)+"
SIMPLE = re.compile(
    rf"""(?P<tag>\*|{IDENTIFIER})|\#(?P<id>{IDENTIFIER})|\.(?P<cls>{IDENTIFIER})"""
    rf"""|\[\s*(?P<attr>{IDENTIFIER})\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>{IDENTIFIER}))\s*)?\]"""
    r"""|:(?P<pseudo>[-a-z]+)(?:\(\s*(?P<arg>[^()]*?)\s*\))?"""
)
NTH = re.compile(r"(?:(?P<a>[-+]?\d*)n)?\s*(?P<b>[-+]?\s*\d+)?\Z")


def unescaped(name: str) -> str:
    return re.sub(r"\\(.)", r"\1", name)


def nth(argument: str) -> tuple[int, int]:
    """a and b of ``an+b``."""
    argument = {"odd": "2n+1", "even": "2n"}.get(argument.lower(), argument.lower())
    found = NTH.match(argument)
    if not argument or not found:
        raise ValueError(f"not a place: {argument!r}")
    a, b = found["a"], int((found["b"] or "0").replace(" ", ""))
    return (0 if a is None else int(a + "1") if a in ("", "+", "-") else int(a)), b


def is_nth(place: int, step: tuple[int, int]) -> bool:
    a, b = step
    return place == b if a == 0 else (place - b) % a == 0 and (place - b) // a >= 0


ATTRIBUTE_TESTS = {
    "=": lambda have, want: have == want,
    "~=": lambda have, want: want in have.split(),
    "|=": lambda have, want: have == want or have.startswith(want + "-"),
    "^=": lambda have, want: bool(want) and have.startswith(want),
    "$=": lambda have, want: bool(want) and have.endswith(want),
    "*=": lambda have, want: bool(want) and want in have,
}


class Compound:
    """What one element must be: tag, id, classes, attributes, place among its siblings."""

    def __init__(self) -> None:
        self.tag: str | None = None
        self.classes: set[str] = set()
        self.attrs: list[tuple[str, str | None, str]] = []
        self.first: list[tuple[int, int]] = []
        self.final: list[tuple[int, int]] = []

    def add(self, part: re.Match) -> None:
        if part["tag"]:
            self.tag = None if part["tag"] == "*" else unescaped(part["tag"]).lower()
        elif part["id"]:
            self.attrs.append(("id", "=", unescaped(part["id"])))
        elif part["cls"]:
            self.classes.add(unescaped(part["cls"]))
        elif part["attr"]:
            value = next((v for v in (part["dq"], part["sq"]) if v is not None), unescaped(part["bare"] or ""))
            self.attrs.append((unescaped(part["attr"]).lower(), part["op"], value))
        else:
            ends = {"first-child": [self.first], "last-child": [self.final], "only-child": [self.first, self.final]}
            steps = {"nth-child": self.first, "nth-last-child": self.final}
            if part["pseudo"] in steps and part["arg"] is not None:
                steps[part["pseudo"]].append(nth(part["arg"]))
            elif part["pseudo"] in ends and part["arg"] is None:
                for side in ends[part["pseudo"]]:
                    side.append((0, 1))
            else:
                raise ValueError(f"unknown selector part {part[0]!r}")

    def matches(self, tree: Tree, own: int) -> bool:
        if self.tag and tree.tag[own] != self.tag:
            return False
        if any(not is_nth(tree.nth[own], s) for s in self.first):
            return False
        if self.final:
            siblings = tree.children[tree.parent[own]] if own else 1
            if any(not is_nth(siblings - tree.nth[own] + 1, s) for s in self.final):
                return False
        if not self.classes and not self.attrs:
            return True
        have = tree.attributes(own)
        if self.classes and not self.classes <= set(have.get("class", "").split()):
            return False
        return all(name in have and (op is None or ATTRIBUTE_TESTS[op](have[name], value)) for name, op, value in self.attrs)


class Selector:
    """A list of complex selectors: compounds joined by descendant, child (``>``), next (``+``) and later sibling (``~``)."""

    def __init__(self, source: str):
        self.chains: list[list[tuple[str, Compound]]] = []
        chain: list[tuple[str, Compound]] = []
        at, joint = 0, ""
        source = source.strip()
        while True:
            compound, begin = Compound(), at
            while found := SIMPLE.match(source, at):
                if found["tag"] and at > begin:
                    break
                compound.add(found)
                at = found.end()
            if at == begin:
                raise ValueError(f"not a selector: {source!r} at {at}")
            chain.append((joint, compound))
            gap = re.compile(r"\s*([,>+~])\s*|\s+").match(source, at)
            if gap is None or gap[1] == ",":
                self.chains.append(chain)
                chain, joint = [], ""
                if gap is None:
                    break
            else:
                joint = gap[1] or " "
            at = gap.end()
        if at != len(source):
            raise ValueError(f"not a selector: {source!r} at {at}")
        last = [c[-1][1].tag for c in self.chains]
        self.tags = None if None in last else sorted(set(last))

    def matches(self, tree: Tree, own: int) -> bool:
        return any(self._fits(tree, own, chain, len(chain) - 1) for chain in self.chains)

    def _fits(self, tree: Tree, own: int, chain: list[tuple[str, Compound]], place: int) -> bool:
        joint, compound = chain[place]
        if not compound.matches(tree, own):
            return False
        if not place:
            return True
        return any(self._fits(tree, other, chain, place - 1) for other in self._joined(tree, own, joint))

    @staticmethod
    def _joined(tree: Tree, own: int, joint: str) -> Iterator[int]:
        parent = tree.parent[own]
        if joint == " ":
            while parent >= 0:
                yield parent
                parent = tree.parent[parent]
        elif joint == ">" and parent >= 0:
            yield parent
        elif joint == "+" and tree.before[own] >= 0:
            yield tree.before[own]
        elif joint == "~":
            while (own := tree.before[own]) >= 0:
                yield own

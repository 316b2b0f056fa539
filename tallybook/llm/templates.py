"""Main text of web pages by removal of site templates.

Every element subtree has two hashes: one of all that is in it (tags, attributes, text, in
order), and one of its shape (tags, names of attributes, classes; alike neighbours count
once, no text and no values). Spark counts on how many pages of a host each occurs, and how much
text and link text it holds there. Template, and deleted whole, are

* containers whose exact hash recurs on many pages of their host (``share`` of them, ``least``
  at least), and paragraphs, headings and items that recur on ``most`` of them;
* containers whose shape recurs on ``most`` of the host's pages, if their text is short
  (``short`` characters a page) or half of it is links: menus, adverts, notices and footers whose
  words differ from page to page;

but nothing that holds half of a page's text on average. Inside an article or main element copies
are content: only containers that recur exactly on ``most`` pages are deleted there, and asides,
forms and the like by their names. Forms, hidden elements and readers' comments are left out everywhere.

A host of fewer than ``least`` pages shows no recurrence. As a fallback, its pages are read by
names: of the article or main element, if there is one, without the elements that never hold main
text by their tag or by the words in their class, id or role. So is a page of which nothing would be left.

Text: character references are decoded, white space within a block becomes one space,
blocks are trimmed and joined by two line feeds. Null and empty html give the empty
text. Pages cut off in the middle end their open elements there. Pages without a host
are one host. Equal rows are separate pages. A subtree that recurs on exactly the asked share counts
as recurring. Very long pages are parsed whole, in time linear in their length; nesting may be of any depth.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import map_batches, written

#: Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Blocks that hold other blocks.
CONTAINERS = BLOCK - frozenset("p pre h1 h2 h3 h4 h5 h6 li dt dd td th tr figcaption caption legend summary blockquote address".split())
#: Tags whose start ends an open paragraph, and item tags that end an open item of their kind.
ENDS_PARAGRAPH = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body", "dt", "dd", "li", "legend", "summary", "figcaption"}
ENDS_ITEM = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements without main text, by tag, role, and words of class and id.
NOT_MAIN = frozenset("nav footer aside form button select input label dialog menu".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
MARKS = frozenset(
    """ad ads advert advertisement adverts advertising adsense banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus
    dropdown footer gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notices notification outbrain pager pagination paywall popup
    promo promoted recommended related reply replies respond share sharing sidebar signup site-footer site-header skip social sponsor sponsored subscribe
    subscription taboola teaser toolbar topbar widget widgets""".split()
)
FORMS = frozenset("form button select input label dialog".split())
#: Of these, words that content is also named by: they count as a whole name, or beside words for a box.
COMMON_MARKS = frozenset("share sharing hidden related social notice notices notification recommended subscription consent skip promo login popup ad".split())
BOXES = frozenset("area article articles bar block box button buttons container cookie item items links list post posts section unit widget wrap wrapper".split())
MAIN_TAGS = ("article", "main")
READERS = frozenset("comment comments commentlist disqus replies respond".split())
MAIN_MARKS = frozenset("article-body article-content entry-content main-content post-body post-content story-body".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACE = re.compile(r"\s+")
WORDS = re.compile(r"[a-z]+")


class Element:
    __slots__ = ("tag", "attrs", "children", "hash", "shape", "size", "links", "holds_main")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []
        self.hash = self.shape = self.size = self.links = 0
        self.holds_main = False


def parse(page: str) -> Element:
    """Tree of elements and texts; forgiving of missing and stray ends."""
    root = Element("")
    stack, at, end = [root], 0, len(page)
    while at < end:
        token = TOKEN.search(page, at)
        stop = token.start() if token else end
        if stop > at:
            stack[-1].children.append(page[at:stop])
        if not token:
            break
        at = token.end()
        tag = (token.group(2) or "").lower()
        if not tag:
            continue
        if token.group(1):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    break
                if tag not in BLOCK and stack[depth].tag in BLOCK:
                    break  # a stray end of an inline element closes no block
            continue
        if tag in ENDS_PARAGRAPH:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    del stack[depth:]
                    break
                if stack[depth].tag in BLOCK:
                    break
        if tag in ENDS_ITEM:
            ended, bounds = ENDS_ITEM[tag]
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in ended:
                    del stack[depth:]
                    break
                if stack[depth].tag in bounds:
                    break
        element = Element(tag, token.group(3) or "")
        stack[-1].children.append(element)
        if tag in RAW and not element.attrs.endswith("/"):
            close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            element.children.append(page[at : close.start() if close else end])
            at = close.end() if close else end
        elif tag not in VOID and not element.attrs.endswith("/"):
            stack.append(element)
    return root


def number(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) >> 1


@lru_cache(maxsize=50_000)
def outline(tag: str, attrs: str) -> str:
    """An element's tag, names of attributes and classes."""
    own = {m[0].lower(): m[1] or m[2] or m[3] for m in ATTRIBUTE.findall(attrs)}
    return f"{tag} {' '.join(sorted(own))} {' '.join(sorted(own.get('class', '').split()))}"


def measure(root: Element) -> list[Element]:
    """All elements below the root, each with the hashes of its subtree and the size of its text and of its links."""
    found, work = [], [(root, False)]
    while work:
        element, ready = work.pop()
        if not ready:
            work.append((element, True))
            work.extend((c, False) for c in element.children if isinstance(c, Element))
            continue
        parts, size, links, shapes = [element.tag, SPACE.sub(" ", element.attrs).strip()], 0, 0, []
        for child in element.children:
            if isinstance(child, Element):
                parts.append(str(child.hash))
                size += child.size
                links += child.links
                element.holds_main |= child.holds_main
                if child.tag not in RAW and (not shapes or shapes[-1] != child.shape):
                    shapes.append(child.shape)
            else:
                text = SPACE.sub(" ", child).strip()
                if text:
                    parts.append(text)
                    size += len(text)
        if element.tag in RAW:
            size = 0
        element.hash, element.size, element.links = number("\x00".join(parts)), size, size if element.tag == "a" else links
        element.shape = number(f"{outline(element.tag, element.attrs)} {shapes}")
        element.holds_main |= element.tag in MAIN_TAGS
        found.append(element)
    return found[:-1]


@lru_cache(maxsize=50_000)
def unread(tag: str, attrs: str) -> bool:
    """Whether an element is code, a form, hidden, or readers' comments."""
    if tag in RAW or tag in FORMS:
        return True
    if not attrs or tag in ("html", "body", *MAIN_TAGS):
        return False
    own = {m[0].lower(): (m[1] or m[2] or m[3]).lower() for m in ATTRIBUTE.findall(attrs)}
    style = SPACE.sub("", own.get("style", ""))
    if "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style:
        return True
    return bool(READERS & set(WORDS.findall(f"{own.get('class', '')} {own.get('id', '')}")))


@lru_cache(maxsize=50_000)
def furniture(tag: str, attrs: str) -> bool:
    """Whether an element of this kind never holds main text."""
    if tag in NOT_MAIN:
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    own = {m[0].lower(): (m[1] or m[2] or m[3]).lower() for m in ATTRIBUTE.findall(attrs)}
    if own.get("role") in ROLES or "hidden" in own or own.get("aria-hidden") == "true":
        return True
    style = SPACE.sub("", own.get("style", ""))
    if "display:none" in style or "visibility:hidden" in style:
        return True
    named = f"{own.get('class', '')} {own.get('id', '')}"
    if MAIN_MARKS & set(named.split()):
        return False
    for name in named.split():
        words = set(WORDS.findall(name))
        if words & (MARKS - COMMON_MARKS) or (words & COMMON_MARKS and words <= COMMON_MARKS | BOXES):
            return True
    return False


def main_parts(root: Element) -> list[Element]:
    """The page's article elements, else its main element, else all of it."""
    for wanted in MAIN_TAGS:
        found, work = [], [root]
        while work:
            element = work.pop()
            if element.tag == wanted or (wanted == "main" and 'role="main"' in element.attrs):
                found.append(element)
                continue
            if element is root or not furniture(element.tag, element.attrs):
                work.extend(c for c in reversed(element.children) if isinstance(c, Element))
        if any(f.size for f in found):
            return found
    return [root]


class Template:
    """What recurs on a host: exact hashes on many pages and on most of them, and shapes."""

    def __init__(self, many: set[int], most: set[int], shapes: set[int]):
        self.many, self.most, self.shapes = many, most, shapes
        self.deleted = 0

    def leaves_out(self, element: Element, inside: bool) -> bool:
        """Whether an element is not read: by its kind, or, counted in ``deleted``, as template."""
        if (furniture if inside else unread)(element.tag, element.attrs):
            return True
        container = element.tag in CONTAINERS and element.tag not in MAIN_TAGS
        recurs = element.hash in self.most and (container or not inside)
        if container and not inside and not recurs:
            recurs = element.hash in self.many or (element.shape in self.shapes and not element.holds_main)
        self.deleted += recurs
        return recurs


class Names:
    """The fallback: elements are left out by their names."""

    deleted = 0

    def leaves_out(self, element: Element, inside: bool) -> bool:
        return furniture(element.tag, element.attrs) or (element.tag == "header" and not inside)


def blocks_of(parts: list[Element], rule: Template | Names) -> list[str]:
    """Texts of the blocks in page order."""
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if line:
            text = SPACE.sub(" ", html.unescape("".join(line))).strip()
            if text:
                blocks.append(text)
            line.clear()

    for part in parts:
        work: list = [(iter(part.children), True, part.tag in MAIN_TAGS)]
        while work:
            children, block, inside = work[-1]
            child = next(children, None)
            if child is None:
                work.pop()
                if block:
                    flush()
            elif isinstance(child, str):
                line.append(child)
            elif rule.leaves_out(child, inside):
                if child.tag in BLOCK:
                    flush()
            elif child.tag == "br":
                line.append(" ")
            else:
                block = child.tag in BLOCK
                if block:
                    flush()
                work.append((iter(child.children), block, inside or child.tag in MAIN_TAGS))
        flush()
    return blocks


def main_text(page: str, template: Template | None) -> tuple[str, int]:
    """Text of a page and the number of subtrees deleted from it; without a template by names alone."""
    root = parse(page)
    measure(root)
    if template is not None and (kept := blocks_of([root], template)):
        return "\n\n".join(kept), template.deleted
    return "\n\n".join(blocks_of(main_parts(root), Names())), 0


def host_of(url: str) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", 1)), F.lit(""))


EXACT, SHAPE, WHOLE = 0, 1, 2


def host_templates(pages: DataFrame, share: float, most: float, least: int, short: int) -> DataFrame:
    """(host, many, most, shapes) of every host of ``least`` pages or more, from (host, html).

    A task adds up what it has read; what recurs on a host is bounded by the subtrees of a
    page divided by ``share``, however many pages the host has.
    """

    def count(batch: pa.RecordBatch):
        found: dict[tuple, list[int]] = {}
        for host, body in zip(*(c.to_pylist() for c in batch.columns)):
            root = parse(body)
            held: dict[tuple, tuple[int, int]] = {}
            for e in measure(root):
                if e.size:
                    held[host, EXACT, e.hash] = e.size, e.links
                    if e.tag in CONTAINERS and not e.holds_main:
                        chars, links = held.get((host, SHAPE, e.shape), (0, 0))
                        held[host, SHAPE, e.shape] = chars + e.size, links + e.links
            held[host, WHOLE, 0] = root.size, root.links
            for key, (chars, links) in held.items():
                sums = found.setdefault(key, [0, 0, 0])
                sums[0] += 1
                sums[1] += chars
                sums[2] += links
        keys, sums = list(zip(*found)) or [()] * 3, list(zip(*found.values())) or [()] * 3
        kinds = [pa.string(), pa.int32(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip([*keys, *sums], kinds)], names=["host", "kind", "hash", "n", "chars", "links"])

    counts = map_batches(pages, count, "host string, kind int, hash long, n long, chars long, links long")
    counts = written(counts.groupBy("host", "kind", "hash").agg(*[F.sum(c).alias(c) for c in ("n", "chars", "links")]).where(F.col("n") >= least), "subtrees")
    hosts = counts.where(F.col("kind") == WHOLE).select("host", F.col("n").alias("pages"), F.col("chars").alias("page_chars"))
    minor = F.col("chars") * 2 < F.col("page_chars") / F.col("pages") * F.col("n")
    plain = (F.col("links") * 2 >= F.col("chars")) | (F.col("chars") <= short * F.col("n"))
    on_most = F.col("n") >= most * F.col("pages")
    many = (F.col("kind") == EXACT) & (F.col("n") >= share * F.col("pages"))
    shape = (F.col("kind") == SHAPE) & on_most & plain
    recurring = counts.where(F.col("kind") != WHOLE).join(hosts, "host").where(minor & (many | shape))
    sets = recurring.groupBy("host").agg(
        F.collect_list(F.when(F.col("kind") == EXACT, F.col("hash"))).alias("many"),
        F.collect_list(F.when((F.col("kind") == EXACT) & on_most, F.col("hash"))).alias("most"),
        F.collect_list(F.when(F.col("kind") == SHAPE, F.col("hash"))).alias("shapes"),
    )
    return hosts.select("host").join(sets, "host", "left")


def extract_main_text(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = 0.05, most: float = 0.5, least: int = 5, short: int = 200, salts: int = 16
) -> DataFrame:
    """page_id, url, text, n_chars and n_deleted (subtrees deleted as template; null: read by names) of every page.

    The html is read twice and meets its host's template compressed; pages of one host are dealt to ``salts`` parts.
    """
    rows = pages.select(
        F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"),
    ).withColumn("host", host_of("url"))
    templates = host_templates(rows.select("host", "html"), share, most, least, short)
    salted = templates.select("*", F.lit(True).alias("known"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    kind = dict(rows.dtypes)["page_id"]

    def pack(batch: pa.RecordBatch):
        packer = zstandard.ZstdCompressor(level=3)
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([packer.compress(b.encode()) for b in batch.column(4).to_pylist()], pa.binary())], names=["page_id", "url", "host", "salt", "packed"])

    def read(batch: pa.RecordBatch):
        unpacker = zstandard.ZstdDecompressor()
        found = []
        for packed, known, many, most_, shapes in zip(*(c.to_pylist() for c in batch.columns[2:])):
            template = Template(set(many or []), set(most_ or []), set(shapes or [])) if known else None
            found.append((*main_text(unpacker.decompress(packed).decode(), template), bool(known)))
        texts = [t for t, _, _ in found]
        columns = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([n if known else None for _, n, known in found], pa.int32())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["page_id", "url", "text", "n_chars", "n_deleted"])

    salt = F.pmod(F.xxhash64("url", "page_id"), F.lit(salts)).cast("int").alias("salt")
    packed = map_batches(rows.select("page_id", "url", "host", salt, "html"), pack, f"page_id {kind}, url string, host string, salt int, packed binary")
    joined = packed.join(salted, ["host", "salt"], "left").select("page_id", "url", "packed", "known", "many", "most", "shapes")
    return map_batches(joined, read, f"page_id {kind}, url string, text string, n_chars long, n_deleted int")

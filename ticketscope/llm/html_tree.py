"""Main text of web pages by scoring the element tree.

Paragraphs pass points for their length and commas to their ancestors; each
ancestor's points are discounted by its link density. The article around the
best container is kept whole, with those siblings that score near it or are
prose themselves.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ticketscope.llm.common import map_arrow

# Element kinds and the words of class and id that mark page furniture.
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROP = frozenset("head script style title textarea noscript iframe noembed noframes xmp template nav footer aside "
                 "form button select option label fieldset input svg canvas object audio video menu dialog".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
                  "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
                  "p pre search section summary table tbody td tfoot th thead tr ul".split())
PARAGRAPH = frozenset("p pre td blockquote li dd div section article main body".split())
CONTAINER = frozenset("article main section div body td blockquote center html".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks of text that stand beside a container which no article or main encloses.
BESIDE = HEADINGS | frozenset("ul ol dl table pre blockquote figure".split())
PAGE = frozenset("#root html body".split())
CLOSES_P = BLOCK - {"html", "body"}
SELF_CLOSING = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"),
                "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
                "option": ("option", "select")}
#: Words of page furniture, whatever other word stands beside them.
SURE = frozenset("ad ads banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus "
                 "footer gdpr login masthead menu modal nav navbar navigation newsletter newsletters notice notices "
                 "notification notifications outbrain pager pagination popup promo promoted related replies reply respond "
                 "share sharing shoutbox sidebar signup skyscraper social subscribe taboola toolbar".split())
#: Words that name furniture or the topic of a section; the content decides.
MAYBE = frozenset("combx community extra foot hidden legal meta remark rss tags tools widget".split())
PROSE = frozenset("article body content entry hentry main page post story text".split())
#: Words of reader comments, which hold prose and headings of their own.
READERS = frozenset("comment comments commentlist disqus replies reply respond".split())
#: Names about the layout or the state of a page, and names that classify a post.
LAYOUT = frozenset("has with without no open closed enabled disabled layout".split())
LABELS = frozenset("category cat tag type status format term".split())
STEMS = re.compile(r"(?:advert|sponsor|recommend)[a-z]*")
GLUED = re.compile(
    r"(?:ads?|comments?|cookies?|footer|menu|nav|newsletter|promo|related|share|sharing|social)"
    r"(?:area|bar|block|box|buttons?|container|content|footer|form|frame|header|item|links?|list|panel|section|slot|space|"
    r"unit|wrap|wrapper|zone)+"
    r"|(?:blog|bottom|global|left|main|page|post|right|site|top|user)(?:ads?|comments?|footer|menu|nav|navigation|sidebar)")
NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Prose (characters of paragraphs outside links) that a page's own article has.
OWN_PROSE = 400
ROLES = frozenset("navigation banner contentinfo complementary search form alert comment dialog menu menubar".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z))"
                 r"|<(/?)([a-zA-Z][^\s/>]*+)", re.S)
#: What comes next inside a tag: its end or the start of a quoted value.
NEXT = re.compile(r">|=\s*+([\"'])")
ATTR = re.compile(r"([^\s\"'=/>]++)(?:\s*+=\s*+(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "children", "bonus", "dropped", "score", "chars", "links", "commas", "blocks",
                 "points", "whole", "suspect", "slug", "prose", "heads", "titles", "holds")

    def __init__(self, tag, parent, bonus=0.0, dropped=False, whole=""):
        self.tag, self.parent, self.children = tag, parent, []
        self.bonus, self.dropped, self.score = bonus, dropped, None
        self.points, self.whole = 0.0, whole
        self.chars = self.links = self.commas = 0
        self.prose = self.heads = self.titles = 0
        self.holds = -1  # prose of the longest article or main within, -1 without one
        self.blocks = False
        self.suspect, self.slug = "", ""


@lru_cache(4096)
def names_say(value: str) -> tuple[str, bool]:
    """What the names of a class or id say: "readers" (comments), "sure" or
    "maybe" furniture or nothing, and whether a word of prose is among them."""
    said, prose = set(), False
    for name in value.split():
        words = [w.lower() for w in NAME_WORDS.findall(name)]
        prose = prose or not PROSE.isdisjoint(words)
        if not words or words[0] in LABELS or not LAYOUT.isdisjoint(words):
            continue
        if not READERS.isdisjoint(words):
            said.add("readers")
        elif name.lower() == "hidden" or any(w in SURE or STEMS.fullmatch(w) or GLUED.fullmatch(w) for w in words):
            said.add("readers" if any(w.startswith("comment") for w in words) else "sure")
        elif not MAYBE.isdisjoint(words):
            said.add("maybe")
    return next((x for x in ("readers", "sure", "maybe") if x in said), ""), prose


def _first_heading(node: Node) -> str:
    stack = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str) or x.dropped:
            continue
        if x.tag in HEADINGS:
            return " ".join(blocks([x]))
        stack.extend(reversed(x.children))
    return ""


def _is_furniture(node: Node) -> bool:
    """Whether an element whose names speak of furniture is that, by its content.

    Not so: what holds the page's own article or title with its prose; a section
    whose id of several words is the slug of its own heading; and, for words that
    may name a topic, a part with headings and prose. Comments always are.
    """
    if node.suspect == "readers":
        return True
    little = _density(node) <= 0.3
    if node.holds >= OWN_PROSE or node.titles and node.prose >= OWN_PROSE and little:
        return False
    if node.suspect == "wrap":
        return node.holds < 0
    told = node.heads and node.prose and little
    if node.slug and told and node.slug == "-".join(re.findall(r"[^\W_]+", _first_heading(node).lower())):
        return False
    return not (node.suspect == "maybe" and told)


def _open(tag: str, attrs: str, parent: Node) -> Node:
    dropped = parent.dropped or tag in DROP
    bonus = {"article": 25.0, "main": 15.0}.get(tag, 0.0)
    whole = tag if tag in ("article", "main") else ""
    found, slug = [], ""
    if not dropped and attrs.strip() and tag not in ("html", "body"):
        for m in ATTR.finditer(attrs):
            name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if name in ("class", "id"):
                if name == "id" and tag in HEADINGS:
                    continue
                kind, prose = names_say((m[2] or "").strip("\"'"))
                if tag in ("article", "main"):
                    dropped = dropped or tag == "article" and kind == "readers"
                elif kind == "maybe" and prose:
                    pass
                elif kind:
                    found.append("wrap" if kind == "sure" and prose else kind)
                    if name == "id" and tag == "section" and value.count("-"):
                        slug = value
                elif prose:
                    bonus += 15.0
            elif name == "itemprop" and value == "comment" or name == "itemtype" and value.endswith("/comment"):
                dropped = True
            elif name == "role":
                dropped = dropped or value in ROLES
                if value in ("main", "article"):
                    bonus += 15.0
                    whole = whole or value
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and \
                    re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                dropped = dropped or name != "aria-hidden"
    if tag == "header" and not dropped:  # an article's own header stays
        up = parent
        while up is not None and up.tag not in ("article", "main"):
            up = up.parent
        dropped = up is None
    node = Node(tag, parent, bonus, dropped, whole)
    node.suspect = next((x for x in ("readers", "sure", "wrap", "maybe") if x in found), "")
    node.slug = slug
    return node


def _tag_end(html: str, at: int, dead: set[int]) -> int:
    """Place of the ``>`` that ends a tag whose attributes start at ``at``:
    quoted values of any length are passed over. If a quote never closes, the
    first ``>``; the page's end without one. ``dead`` collects the places after
    values from which no end is found, so that each is tried once a page."""
    now, path = at, []
    while now not in dead and (m := NEXT.search(html, now)):
        if not m[1]:
            return m.start()
        close = html.find(m[1], m.end())
        if close < 0:
            break
        now = close + 1
        path.append(now)
    dead.update(path)
    first = html.find(">", at)
    return first if first >= 0 else len(html)


def parse(html: str) -> Node:
    """Element tree; text stands as strings among the children."""
    root = top = Node("#root", None)
    at, low = 0, None
    dead: set[int] = set()
    for m in iter(lambda: TAG.search(html, at), None):
        if m.start() > at:
            top.children.append(html[at:m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            if m[0].startswith("<![CDATA["):
                top.children.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        end = _tag_end(html, at, dead)
        attrs, at = html[at:end], min(end + 1, len(html))
        tag = tag.lower()
        if m[1]:
            up = top
            while up.parent is not None and up.tag != tag:
                up = up.parent
            if up.parent is not None:
                top = up.parent
            continue
        if tag in CLOSES_P:
            up = top
            while up.parent is not None and up.tag != "p" and (up.tag not in BLOCK):
                up = up.parent
            if up.tag == "p":
                top = up.parent
        if tag in SELF_CLOSING:
            same, stop = (x.split() for x in SELF_CLOSING[tag])
            up = top
            while up.parent is not None and up.tag not in same and up.tag not in stop:
                up = up.parent
            if up.tag in same:
                top = up.parent
        node = _open(tag, attrs, top)
        top.children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            low = low if low is not None else html.lower()
            end = low.find("</" + tag, at)
            at = len(html) if end < 0 else end
        top = node
    if at < len(html):
        top.children.append(html[at:])
    return root


def _measure(root: Node) -> None:
    """Characters, characters in links and commas of every kept element, without
    recursion; suspected furniture is settled from the inside out."""
    stack = [(root, False, False)]
    while stack:
        node, link, done = stack.pop()
        if node.dropped:
            continue
        if done:
            for c in node.children:
                if isinstance(c, Node):
                    if not c.dropped:
                        node.chars += c.chars
                        node.links += c.links
                        node.commas += c.commas
                        node.blocks = node.blocks or c.blocks or c.tag in BLOCK
                        node.prose += c.chars - c.links if c.tag == "p" else c.prose
                        node.heads += c.heads + (c.tag in HEADINGS and c.chars > 0)
                        node.titles += c.titles + (c.tag == "h1" and c.chars > 0)
                        node.holds = max(node.holds, c.holds, c.prose if c.tag in ("article", "main") else -1)
                else:
                    n = len(SPACE.sub(" ", c).strip())
                    node.chars += n
                    node.links += n * link
                    node.commas += c.count(",") + c.count("、") + c.count("，")
            node.dropped = bool(node.suspect) and _is_furniture(node)
            continue
        stack.append((node, link, True))
        stack.extend((c, link or c.tag == "a", False) for c in node.children if isinstance(c, Node))


def _elements(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        node = stack.pop()
        if not node.dropped:
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))


def _density(node: Node) -> float:
    return node.links / node.chars if node.chars else 0.0


def _enclosing(best: Node, root: Node) -> Node:
    """The whole that ``best`` is a part of: its outermost article, else its
    outermost main. Without these, the ancestor up to which a lone paragraph, a
    section or a quotation continues, headings stand beside, or most of the
    page's points are not yet held."""
    found: dict[str, Node] = {}
    up = best
    while up is not None:
        found[up.whole] = up
        up = up.parent
    if "article" in found or "main" in found:
        return found.get("article") or found["main"]
    for node in reversed(list(_elements(root))):  # children before their parents
        if node.parent is not None:
            node.parent.points += node.points
    while best.tag not in PAGE:
        up = best.parent
        part = best.tag in ("section", "blockquote") or not best.blocks
        titled = up.tag not in PAGE and any(
            isinstance(c, Node) and not c.dropped and c.tag in HEADINGS for c in up.children)
        if not (part and up.points > best.points or titled or 2 * best.points <= root.points):
            break
        best = up
    return best


def keep(root: Node, sibling_share: float = 0.2) -> list[Node | str]:
    """The whole around the best container and those of its siblings that are kept, in page order."""
    _measure(root)
    scored: list[Node] = []
    for node in _elements(root):
        if node.tag not in PARAGRAPH or node.blocks or not node.chars:
            continue
        points = node.points = (1.0 + node.commas + min(node.chars / 100.0, 3.0)) * (1.0 - _density(node))
        up, share = (node if node.tag in CONTAINER else node.parent), 1.0
        for level in range(3):
            if up is None or up.tag == "#root":
                break
            if up.score is None:
                up.score = up.bonus
                scored.append(up)
            up.score += points * share
            up, share = up.parent, 1.0 / (level + 2)
    if not scored:
        return [root]
    best = max(scored, key=lambda x: x.score * (1.0 - _density(x)))  # ties: the first in page order
    least = max(10.0, sibling_share * best.score * (1.0 - _density(best)))
    top = _enclosing(best, root)
    if top is not best and top.tag in PAGE:  # the whole page, without its lists of links
        return [x for x in top.children if isinstance(x, str) or not x.dropped and _density(x) <= 0.5]
    if top.parent is None:
        return [top]
    kept = []
    for node in top.parent.children:
        if node is top:
            kept.append(node)
        elif isinstance(node, Node) and not node.dropped:
            own = (node.score or 0.0) * (1.0 - _density(node))
            prose = (node.tag == "p" and node.chars > 80 or node.tag in BESIDE and not top.whole) and _density(node) < 0.25
            if node.score is not None and own >= least and node.tag == top.tag or prose or node.tag == "h1":
                kept.append(node)
    return kept


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks in page order: references decoded, white space one space, trimmed."""
    out: list[str] = []
    now: list[str] = []

    def flush():
        if now:
            if s := " ".join(unescape("".join(now)).split()):
                out.append(s)
            now.clear()

    stack: list = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            now.append(x)
        elif x.tag == "br":
            now.append(" ")
        elif not x.dropped:
            if x.tag in BLOCK or x.tag == "#root":
                flush()
                stack.append(None)
            stack.extend(reversed(x.children))
    flush()
    return out


def main_text(html: str | None) -> str:
    """Main text of one page; empty if there is none."""
    if not html:
        return ""
    return "\n".join(blocks(keep(parse(html))))


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every row of ``pages`` (page_id, url, html).

    One row per input row, repeated rows included. Null or empty html, and a
    page of furniture only, give an empty text of 0 code points; null
    ``page_id`` and ``url`` pass through. Other columns are ignored. A map
    over rows: no shuffle, one page in memory at a time.
    """
    def run(batch: pa.RecordBatch):
        found = [main_text(x) for x in batch.column("html").to_pylist()]
        yield {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": found,
               "n_chars": [len(x) for x in found]}

    return map_arrow(pages.selectExpr("cast(page_id as long) page_id", "url", "html"), run, SCHEMA)

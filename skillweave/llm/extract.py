"""Main text of web pages by tree scoring.

A page becomes a tree.  Every paragraph passes points, for its length and its commas, to its parent and half as many to
its grandparent; a node's points are discounted by its link density.  The best container is kept with those siblings
that are no boilerplate; if it lies in an article or main element, that whole element is kept.  Elements that are menus,
headers, footers, sidebars or forms by their tag or role are left out, as are scripts and styles.

Class names and ids only make an element suspect, and only if a whole name says nothing but what boilerplate it is
(``cookie-notice``, ``main-nav``; not ``no-sidebar``, not ``social-history``).  A suspect element goes, unless it holds
the greater part of the page's text and few links: then the name describes the layout and not the text.  Reader comments
go at any length, as long as there is other text.

One pass reads a page, counts go from a node to its parent when it closes, and whether a node is kept is passed down once:
time and memory are in proportion to the page, however deep or broken its markup is.

A null or empty page, and one without text, gives an empty text.  Pages are independent of each other: repeated rows give
repeated results, other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillweave.llm.shared import small_batches

# Element names of HTML by their part in a page, and names that pages give to boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe title xmp noframes textarea".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("head nav footer aside button select dialog menu".split())
#: Dropped unless most of the page is inside.
FORMS = frozenset(("form", "fieldset"))
PARAGRAPHS = frozenset("p pre blockquote td th li dd dt h1 h2 h3 h4 h5 h6 figcaption".split())
BOILERPLATE = frozenset(
    """ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar nav navbar navigation
    menu breadcrumb breadcrumbs footer masthead comment comments disqus replies cookie cookies consent gdpr notice notices
    popup modal overlay newsletter subscribe signup share sharing social related recommended widget pagination pager toolbar
    login search""".split()
)
COMMENT_NAMES = frozenset("comment comments reply replies disqus".split())
#: Words that say where an element stands and nothing about its text.
PLACES = frozenset("site main page top bottom left right global primary secondary list item items box block wrapper wrap container area section inner outer links buttons button bar post posts article user reader form col column row js the".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
CLOSED_BY_SAME = {
    "li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("table",)), "th": (("td", "th"), ("table",)), "option": (("option",), ("select",)),
}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|</[^>]*+(?:>|\Z)", re.DOTALL
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
NAME_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")

LEAST_CHARS = 25
MOST_LINKS = 0.33
#: The part of a page's points that its main element has at least, and that an article has beside the best one's.
MOST_POINTS, OTHER_ARTICLE = 0.75, 0.3


class Node:
    __slots__ = ("chars", "comments", "dropped", "in_article", "kept", "links", "parent", "points", "suspect", "tag", "total")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, in_article: bool):
        self.tag, self.parent, self.dropped, self.in_article = tag, parent, dropped, in_article
        self.points, self.total, self.chars, self.links = 0.0, 0.0, 0, 0
        self.kept = self.suspect = self.comments = False


def named_boilerplate(names: str) -> tuple[bool, bool]:
    """Whether one of the names says only what boilerplate an element is, and whether that is reader comments."""
    suspect = comments = False
    for name in names.split():
        parts = [p.lower() for p in NAME_PARTS.findall(name) if not p.isdigit()]
        said = [p for p in parts if p not in PLACES]
        if said and BOILERPLATE.issuperset(said):
            suspect = True
            comments = comments or not COMMENT_NAMES.isdisjoint(said)
    return suspect, comments


class Page:
    """Blocks of text, in page order, each with the tree node that holds it."""

    def __init__(self, html: str):
        self.root = Node("#root", None, False, False)
        self.stack, self.nodes = [self.root], [self.root]
        self.blocks: list[tuple[str, Node]] = []
        #: Depths of the open elements that aren't inline, and by tag of all open ones.
        self.outer: list[int] = [0]
        self.opens: dict[str, list[int]] = {}
        self.parts, self.link_chars, self.link_depth = [], 0, 0
        self._parse(html)
        self._flush()
        self._leave(1)

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            node = self.stack[self.outer[-1]]
            self.blocks.append((text, node))
            node.chars += len(text)
            node.links += min(self.link_chars, len(text))
        self.parts, self.link_chars = [], 0

    def _text(self, raw: str) -> None:
        if raw:
            text = unescape(raw) if "&" in raw else raw
            self.parts.append(text)
            if self.link_depth:
                self.link_chars += len(text.strip())

    def _leave(self, depth: int) -> None:
        """Close all elements from ``depth`` on; their counts go to their parents."""
        while len(self.stack) > depth:
            node = self.stack.pop()
            at = len(self.stack)
            if self.outer[-1] == at:
                self.outer.pop()
            self.opens[node.tag].pop()
            self.link_depth -= node.tag == "a"
            node.parent.chars += node.chars
            node.parent.links += node.links

    def _pop_to(self, depth: int) -> None:
        if self.outer[-1] >= depth:
            self._flush()
        self._leave(depth)

    def _open(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if tag not in INLINE:
            self._flush()
            self._close_implied(tag)
        if tag in VOID:
            return
        if tag == "a" and self.link_depth:  # a link can't hold another
            self._close("a")
        top = self.stack[-1]
        node = Node(tag, top, top.dropped or tag in DROPPED or (tag == "header" and not top.in_article), top.in_article or tag in ("article", "main"))
        if not node.dropped and attributes.strip():
            self._judge(node, attributes, top.in_article)
        node.suspect = node.suspect or tag in FORMS
        depth = len(self.stack)
        self.stack.append(node)
        self.nodes.append(node)
        self.opens.setdefault(tag, []).append(depth)
        if tag not in INLINE:
            self.outer.append(depth)
        self.link_depth += tag == "a"

    @staticmethod
    def _judge(node: Node, attributes: str, in_article: bool) -> None:
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
        names = f"{found.get('class', '')} {found.get('id', '')}"
        if node.tag in ("html", "body", "main"):
            return
        suspect, node.comments = named_boilerplate(names)
        if node.tag == "article":  # an article of its own, unless it is a reader's
            node.suspect = node.comments
            return
        node.dropped = found.get("role", "").lower() in DROPPED_ROLES
        node.suspect = suspect or (not in_article and any([p.lower() for p in NAME_PARTS.findall(n)][-1:] == ["header"] for n in names.split()))

    def _nearest(self, tags: tuple[str, ...]) -> int:
        return max([self.opens[t][-1] for t in tags if self.opens.get(t)], default=-1)

    def _close_implied(self, tag: str) -> None:
        """A block ends an open paragraph; a list item or cell ends the one before it."""
        if tag in CLOSED_BY_SAME:
            same, scope = CLOSED_BY_SAME[tag]
            depth = self._nearest((*same, "p"))
            if depth > self._nearest(scope):
                self._pop_to(depth)
        elif self.stack[self.outer[-1]].tag == "p":
            self._pop_to(self.outer[-1])

    def _close(self, tag: str) -> None:
        depth = self._nearest((tag,))
        if depth > 0 and (tag not in INLINE or self.outer[-1] < depth):
            self._pop_to(depth)

    def _parse(self, html: str) -> None:
        at, low = 0, None
        while True:
            m = TOKEN.search(html, at)
            if m is None:
                self._text(html[at:])
                return
            self._text(html[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag or (m[2] is None and not m[0].endswith(">")):
                continue
            if m[1] or m[4]:
                self._close(tag)
                continue
            attributes = m[3] if m[2] else m[6] or ""
            if tag in RAW and not attributes.rstrip().endswith("/"):
                low = html.lower() if low is None else low
                end = low.find(f"</{tag}", at) if len(low) == len(html) else -1
                if end < 0:
                    found = re.compile(f"</{tag}", re.IGNORECASE).search(html, at)
                    end = found.start() if found else len(html)
                at = end
                continue
            self._open(tag, attributes)

    def _drop_suspects(self) -> None:
        """Suspect elements go unless they are the page; what goes takes everything in it along.

        A node stands in ``nodes`` after its parent, so one pass hands verdicts down.
        """
        whole = self.root.chars
        for node in self.nodes[1:]:
            if node.parent.dropped:
                node.dropped = True
            elif node.suspect:
                greater = 2 * node.chars > whole and self._link_density(node) < MOST_LINKS
                node.dropped = whole - node.chars >= LEAST_CHARS if node.comments else not greater

    def _score(self) -> list[Node]:
        scored: dict[int, Node] = {}
        for text, node in self.blocks:
            if node.dropped or len(text) < LEAST_CHARS:
                continue
            points = 1 + text.count(",") + min(len(text) / 100, 3)
            node.total += points * (1 - self._link_density(node))
            first = node.parent if node.tag in PARAGRAPHS and node.parent is not None else node
            for target, share in ((first, 1.0), (first.parent, 0.5)):
                if target is not None:
                    target.points += share * points
                    scored[id(target)] = target
        for node in reversed(self.nodes[1:]):  # children come after their parents
            node.parent.total += node.total
        return list(scored.values())

    @staticmethod
    def _link_density(node: Node) -> float:
        return node.links / node.chars if node.chars else 0.0

    def main_text(self) -> str:
        self._drop_suspects()
        best, most = None, 0.0
        for node in self._score():
            value = node.points * (1 - self._link_density(node))
            if value > most:
                best, most = node, value
        if best is None:
            kept = [b for b in self.blocks if not b[1].dropped and (b[1].in_article or self._link_density(b[1]) < MOST_LINKS)]
            return " ".join([text for text, _ in kept])
        main, node = None, best
        while node is not None:
            if node.tag in ("article", "main"):
                main = node
            node = node.parent
        if main is not None:
            self._keep(self._articles(main))
        elif best.total >= MOST_POINTS * self.root.total:
            self._keep([best], best.parent)  # its own text and its good children are kept
        else:  # the article stands in several parts: the least element that holds most of it, with all its good parts
            while best.parent is not None and best.total < MOST_POINTS * self.root.total:
                best = best.parent
            self._keep([best], link_lists=False)
        self._keep_headline()
        return " ".join([text for text, node in self.blocks if node.kept and not node.dropped])

    def _articles(self, main: Node) -> list[Node]:
        """``main``, and the articles beside it that have a good part of its points."""
        inside, out = {id(main)}, [main]
        for node in self.nodes:
            if node.parent is not None and id(node.parent) in inside:
                inside.add(id(node))
            elif node.tag == "article" and not node.dropped and node is not main and node.total >= OTHER_ARTICLE * main.total:
                inside.add(id(node))
                out.append(node)
        return out

    def _keep(self, chosen: list[Node], beside: Node | None = None, link_lists: bool = True) -> None:
        """Keep what is in ``chosen``, and the good children of ``beside``; without ``link_lists`` no part that is mostly links."""
        own = {id(node) for node in chosen}
        for node in self.nodes:
            if id(node) in own:
                node.kept = True
            elif node.parent is not None and node.parent is beside:
                node.kept = not node.dropped and self._link_density(node) < MOST_LINKS
            else:
                inherited = node.parent is not None and node.parent is not beside and node.parent.kept
                node.kept = node is beside or (inherited and (link_lists or node.tag in INLINE or self._link_density(node) < MOST_LINKS))

    def _keep_headline(self) -> None:
        """The page's only h1, if it stands before all that is kept and nothing kept is a headline of the first order."""
        heads = [node for node in self.nodes if node.tag == "h1" and not node.dropped and node.chars]
        if len(heads) != 1 or heads[0].kept:
            return
        order = {id(node): k for k, node in enumerate(self.nodes)}
        first = next((order[id(node)] for _, node in self.blocks if node.kept and not node.dropped), -1)
        if order[id(heads[0])] < first and self._link_density(heads[0]) < MOST_LINKS:
            inside = {id(heads[0])}
            for node in self.nodes:
                if node.parent is not None and id(node.parent) in inside:
                    inside.add(id(node))
                node.kept = node.kept or id(node) in inside


def main_text(html: str | None) -> str:
    return Page(html).main_text() if html else ""


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    small_batches(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")

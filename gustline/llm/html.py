"""Main text of web pages by tree scoring.

Each paragraph passes points for its length and commas to its parent and, with
less weight, to the ancestors above; a container's points are discounted by the
share of its text that stands in links. The best container and those of its
siblings that score near it, or read like prose, are the article.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustline.llm.common import in_arrow, in_bytes, ship_package

#: A quote has a meaning only after "=", and only if another closes it.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|style|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")

# How HTML elements behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr label".split())
CLOSES_P = frozenset("address article aside blockquote details div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main nav ol p pre section table ul".split())
NEVER = frozenset("script style noscript iframe template xmp textarea title head nav footer aside form button select option input menu dialog svg object embed canvas audio video map datalist".split())
#: Names of parts that aren't the article, as whole words of class, id or role.
BAD_WORDS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar side aside widget related recommended recommendations more-links popular trending share sharing social comment comments reply replies respond discussion disqus notice notices cookie cookies consent gdpr modal popup overlay newsletter subscribe subscription signup login form search pagination pager skip copyright legal disclaimer toolbar toc tags".split())
GOOD_WORDS = frozenset("article body content entry main post story text blog hentry page articlebody".split())
#: Elements that a name alone doesn't make bad.
ROOTS = frozenset("html body article main".split())
#: "has-sidebar", "no-comments": what is said of a part, not its name.
_ABOUT = re.compile(r"(?<![A-Za-z])(?:has|have|with|without|no|not)[-_]+[A-Za-z]+", re.I)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPH = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6".split())
_WORD = re.compile(r"[A-Za-z]+")


class Node:
    __slots__ = ("tag", "parent", "children", "bad", "good", "doubtful", "points", "chars", "link_chars", "length", "commas")

    def __init__(self, tag: str, parent: "Node | None", names: str = "", hidden: bool = False):
        self.tag, self.parent, self.children = tag, parent, []
        words = {w.lower() for w in _WORD.findall(_ABOUT.sub(" ", names))} if names else ()
        self.good = bool(words) and not GOOD_WORDS.isdisjoint(words) or tag in ("article", "main")
        named = bool(words) and not BAD_WORDS.isdisjoint(words)
        self.doubtful = named and self.good and tag not in ROOTS  # its share of links decides
        self.bad = hidden or tag in NEVER or named and not self.good and tag not in ROOTS or tag == "header" and (parent is None or parent.tag in ("body", "html", "root"))
        self.points = 0.0
        self.chars = self.link_chars = self.length = self.commas = 0


def parse(page: str) -> Node:
    """A tree of nodes and strings; ends that the markup leaves out are put in, unknown ends ignored."""
    root = node = Node("root", None)
    at, n, open_ = 0, len(page), Counter()
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            node.children.append(page[at:])
            break
        if m.start() > at:
            node.children.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if open_[tag]:
                node = _left(node, _close(node, tag), open_)
            continue
        if tag in CLOSES_P:
            node = _left(node, _close_p(node, tag), open_)
        names, hidden = "", False
        if m[3]:
            for a in _ATTRIBUTE.finditer(m[3]):
                key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if key in ("class", "id", "role", "itemprop"):
                    names += " " + value
                elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                    hidden = True
        child = Node(tag, node, names, hidden)
        node.children.append(child)
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>]|\\Z)", re.I).search(page, at)
            at = n if not end else end.start()
            if end and (close := page.find(">", at)) >= 0:
                at = close + 1
            elif end:
                at = n
        elif tag not in VOID and not m[3].endswith("/"):
            node = child
            open_[tag] += 1
    return root


def _left(node: Node, to: Node, open_: Counter) -> Node:
    """``to``; the elements up to it are open no longer."""
    while node is not to:
        open_[node.tag] -= 1
        node = node.parent
    return to


def _close(node: Node, tag: str) -> Node:
    up = node
    while up.parent is not None:
        if up.tag == tag:
            return up.parent
        if tag in INLINE and up.tag not in INLINE:
            return node  # a stray inline end doesn't close a block
        up = up.parent
    return node


_SAME = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "tr": ("tr",), "option": ("option",)}
_STOP = frozenset("ul ol dl table div article section main body html root td th blockquote".split())


def _close_p(node: Node, tag: str) -> Node:
    """Where a block that ends an open paragraph (or its like) starts."""
    ends = ("p", *_SAME.get(tag, ()))
    up = node
    while up.parent is not None and (up.tag not in _STOP or up.tag in ends):
        if up.tag in ends:
            return up.parent
        up = up.parent
    return node


def score(root: Node) -> Node | None:
    """Pass the points on and choose the best container, None if no paragraph has any text."""
    containers: dict[int, Node] = {}
    stack: list[tuple[Node, bool, bool]] = [(root, False, False)]
    order: list[Node] = []
    while stack:
        node, in_link, done = stack.pop()
        if node.bad:
            continue
        in_link = in_link or node.tag == "a"
        if done:
            for c in node.children:
                if isinstance(c, str):
                    k = len(c.strip())
                    node.chars += k
                    node.link_chars += k if in_link else 0
                    node.length += len(c)
                    node.commas += c.count(",")
                elif not c.bad:
                    node.chars += c.chars
                    node.link_chars += c.link_chars
                    node.length += c.length
                    node.commas += c.commas
            if node.doubtful and 2 * node.link_chars > node.chars:
                node.bad = True
            order.append(node)
            continue
        stack.append((node, in_link, True))
        stack += [(c, in_link, False) for c in node.children if not isinstance(c, str)]
    out: set[int] = set()  # what turned out bad, and what is in it
    for node in reversed(order):  # parents first
        if node.bad or node.parent is not None and id(node.parent) in out:
            out.add(id(node))
    for node in order:
        if id(node) in out:
            continue
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        if not node.chars or node.tag not in PARAGRAPH and (node.tag in INLINE or not own):
            continue
        points = (1 + node.commas + min(node.length / 100, 3)) * (1 - node.link_chars / node.chars)
        up, weight = (node if node.tag not in PARAGRAPH else node.parent), 1.0
        while up is not None and weight > 0.1:
            if up.tag not in INLINE and up.tag not in PARAGRAPH:
                up.points += points * weight
                containers[id(up)] = up
                weight /= 2
            up = up.parent
    best, most = None, 0.0
    for c in containers.values():
        points = (c.points + (25 if c.good else 0)) * (1 - c.link_chars / max(1, c.chars))
        if c.tag in ("html", "root"):
            points *= 0.5
        if points > most:
            best, most = c, points
    if best is not None:
        best.points = most
    return best


def _chosen(best: Node) -> list[Node]:
    """The best container and its siblings that score near it, are headings or read like prose, however short."""
    if best.parent is None or best.tag in ("article", "main", "body", "html"):
        return [best]
    out = []
    for s in best.parent.children:
        if s is best:
            out.append(s)
        elif not isinstance(s, str) and not s.bad and s.chars:
            links = s.link_chars / s.chars
            if s.points * (1 - links) >= max(10, 0.2 * best.points) or s.tag in PARAGRAPH and links < 0.25 or s.tag in HEADING and links < 1:
                out.append(s)
    return out


def _blocks(node: Node, out: list[list[str]]) -> None:
    """Append the runs of text under the node; a block element starts a new one on either side. However deep, no recursion."""
    stack: list[Node | str | None] = list(reversed(node.children))
    while stack:
        c = stack.pop()
        if c is None:
            out.append([])
        elif isinstance(c, str):
            out[-1].append(c)
        elif not c.bad:
            if c.tag == "br":
                out[-1].append(" ")
            elif c.tag in INLINE:
                stack += reversed(c.children)
            else:
                out.append([])
                stack.append(None)
                stack += reversed(c.children)


def extract(page: str) -> str:
    """The article's blocks, one a line; character references decoded, white space made single spaces."""
    best = score(parse(page))
    if best is None:
        return ""
    runs: list[list[str]] = [[]]
    for node in _chosen(best):
        _blocks(node, runs)
        runs.append([])
    lines = (_SPACE.sub(" ", html.unescape("".join(r))).strip() for r in runs)
    return "\n".join(x for x in lines if x)


def _kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in in_bytes(batches, 2):
        got = [extract(x) for x in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.string()), pa.array([len(x) for x in got], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page, from its whole html.

    Null or empty html, and pages without an article, give an empty text. Equal
    rows are extracted each on their own; other columns are left out; an empty
    table gives no rows; nothing is shuffled.
    """
    ship_package(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return rows.transform(in_arrow, _kernel, "page_id long, url string, text string, n_chars long")

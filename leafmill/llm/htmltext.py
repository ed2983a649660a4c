"""Main text of web pages by composite text density.

Each page becomes a tree; for every node characters and tags are counted, in links and in all,
and give its link-adjusted characters-per-tag. The densest node's path from the body sets the
threshold; of the nodes that reach it, the one whose children's densities have the largest sum
holds the text.

Names of elements, classes, ids and roles only weigh in: a part named as a menu, an advert, a
comment and so on has no density and stays out of the text, unless most of the page's unlinked
text is in it. Names that negate such a word or put another one behind it ("with-sidebar",
"social-science") halve a part's density; it is left out only if its text is mostly links.
"""

from __future__ import annotations

import bisect
import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import bounded, slices

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
LEFT_OUT = frozenset("script style template noscript nav footer aside form button select option datalist textarea title head iframe noembed noframes xmp svg audio video canvas map input".split())
#: Of these, what may as well wrap a whole page.
MAY_WRAP = frozenset("nav footer aside form".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul option optgroup".split())
CLOSES_P = BLOCK - frozenset("body caption html legend option optgroup tbody td tfoot th thead tr".split())
#: An opening tag ends these open ones, up to the nearest of the others.
ENDS = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist"})),
}
# Words in class, id or role that mark what is no part of an article.
MARKS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs masthead footer sidebar aside complementary contentinfo widget widgets "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login "
    "social share sharing sharebar related recommended recommendations teaser comment comments disqus respond reply replies "
    "form search searchbox pagination pager toolbar skip skiplink".split()
)
COMMENTS = frozenset("comment comments disqus respond reply replies".split())
TOP_MARKS = frozenset({"header", "banner"})
# Words that say nothing by themselves next to a mark, and words that turn it round.
PLAIN = frozenset(
    "area bar block body bottom box button buttons card center col column container content desktop end entry fixed floating form global grid group head header "
    "heading hidden icon icons id img inner inline item items label large layout left level line link links list lists main mobile open outer page pane panel "
    "component css module post posts primary region right root row secondary section side single site slot small start sticky story stories strip text thread title toggle tool tools top unit user view web wide wp wrap wrapper zone".split()
)
NEGATIONS = frozenset("with without no not non has have hide disable disabled off is".split())
#: How a doubtful name weighs; the share of links above which such a part goes.
DOUBT, MOSTLY_LINKS = 0.5, 0.5

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[/a-zA-Z][^>]*\Z""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("tag", "parts", "parent", "marks", "doubt", "hidden", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag, parent, marks=frozenset(), doubt=False, hidden=False):
        self.tag, self.parent, self.marks, self.doubt, self.hidden = tag, parent, marks, doubt, hidden
        self.parts: list = []  # texts and nodes in page order


class _Open:
    """The open elements, with their places by tag, so that no end tag has to climb."""

    def __init__(self, root: Node):
        self.nodes, self.places, self.blocks = [root], {}, []

    def last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in BLOCK and node.tag != "p":
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, place: int) -> None:
        """Close the element at ``place`` and all inside of it."""
        while len(self.nodes) > place:
            tag = self.nodes.pop().tag
            self.places[tag].pop()
            if tag in BLOCK and tag != "p":
                self.blocks.pop()

    def close(self, tag: str) -> None:
        place = self.last((tag,))
        # an inline end does not close a block
        if place and (tag in BLOCK or not self.blocks or self.blocks[-1] < place):
            self.cut(place)

    def end(self, which: frozenset, limit: int) -> None:
        """Close the outermost of ``which`` that is open behind ``limit``."""
        found = [p[at] for p in map(self.places.get, which) if p and (at := bisect.bisect_right(p, limit)) < len(p)]
        if found:
            self.cut(min(found))


def parse(source: str) -> Node:
    """A tree of the page; tags that are never closed end with what holds them."""
    root = Node("#root", None)
    opened = _Open(root)
    done, n = 0, len(source)
    while done < n:
        m = _TOKEN.search(source, done)
        if m is None:
            opened.nodes[-1].parts.append(html.unescape(source[done:]))
            break
        if m.start() > done:
            opened.nodes[-1].parts.append(html.unescape(source[done : m.start()]))
        done = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            opened.close(tag)
            continue
        if tag in CLOSES_P:
            opened.end(_P, opened.blocks[-1] if opened.blocks else 0)
        if tag in ENDS:
            which, until = ENDS[tag]
            opened.end(which, opened.last(until))
        at = opened.nodes[-1]
        node = Node(tag, at, *_marks(m[3] or m[6] or ""))
        at.parts.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, done)
            done = end.end() if end else n
        elif tag not in VOID:
            opened.push(node)
    return root


_P = frozenset({"p"})


def named(names: str) -> tuple[frozenset, bool]:
    """(marks, doubt) of class names: marks that are meant, and whether one is only part of a name.

    A name is what its last word of weight says ("reader-comments"); a mark before another word
    ("social-science"), or behind a negation ("with-sidebar", "page-no-comments"), is in doubt."""
    marks, doubt = set(), False
    for name in names.split():
        words = [w.lower() for w in _WORD.findall(name)]
        places = [i for i, w in enumerate(words) if w in MARKS or w in TOP_MARKS]
        if not places:
            continue
        weighty = [w for w in words if w in MARKS or w in TOP_MARKS or w not in PLAIN and len(w) > 2]
        if any(w in NEGATIONS for w in words[: places[-1]]) or weighty[-1] not in MARKS and weighty[-1] not in TOP_MARKS:
            doubt = True
        else:
            marks.update(words[i] for i in places)
    return frozenset(marks), doubt


def _marks(attributes: str) -> tuple[frozenset, bool, bool]:
    if not attributes.strip(" /\n\t\r"):
        return frozenset(), False, False
    names, hidden = [], False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role"):
            names.append("".join(values))
        elif name == "hidden" or name == "aria-hidden" and "true" in values:
            hidden = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", "".join(values), re.I):
            hidden = True
    return *named(" ".join(names)), hidden


def _nodes(root: Node) -> list[Node]:
    """All nodes, each before what it holds."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(x for x in reversed(node.parts) if isinstance(x, Node))
    return out


def _left_out(node: Node) -> bool:
    return node.tag in LEFT_OUT and node.tag not in MAY_WRAP


def _unlinked(nodes: list[Node]) -> dict[int, int]:
    """Characters of each node that can be read and lie in no link."""
    out: dict[int, int] = {}
    for node in reversed(nodes):
        own = sum(len(x.strip()) if isinstance(x, str) else out[id(x)] for x in node.parts)
        out[id(node)] = 0 if node.tag == "a" or node.hidden or _left_out(node) else own
    return out


def _prune(root: Node) -> None:
    """Leave out what is named as no part of an article, unless the article is inside of it."""
    nodes = _nodes(root)
    holds, inside = set(), set()  # an article or main; inside of one
    for node in nodes:
        if node.tag in ("article", "main") and not node.marks & COMMENTS:
            up = node
            while up is not None and id(up) not in holds:
                holds.add(id(up))
                up = up.parent
        if node.parent is not None and (id(node.parent) in inside or node.parent.tag in ("article", "main")):
            inside.add(id(node))
    free = _unlinked(nodes)
    article = any(x.tag in ("article", "main") and not x.marks & COMMENTS and free[id(x)] for x in nodes)

    def is_named(node: Node) -> bool:
        top = (node.tag == "header" or node.marks & TOP_MARKS) and id(node) not in inside
        return node.tag not in ("html", "body", "article", "main") and bool(node.tag in MAY_WRAP or top or node.marks & MARKS) or node.tag in ("article", "main") and bool(node.marks & COMMENTS)

    outermost: set[int] = set()
    covered = set()
    for node in nodes:
        if node.parent is not None and id(node.parent) in covered:
            covered.add(id(node))
        elif is_named(node):
            outermost.add(id(node))
            covered.add(id(node))
    rest = free[id(root)] - sum(free[i] for i in outermost)
    gone = set()
    for node in nodes:
        if node.parent is not None and id(node.parent) in gone:
            gone.add(id(node))
            continue
        out = _left_out(node) or node.hidden and id(node) not in holds
        if not out and is_named(node) and (id(node) not in holds or node.marks & COMMENTS):
            own = free[id(node)]
            sure = node.marks & COMMENTS or node.tag in ("nav", "footer", "aside")
            out = rest * (20 if sure else 3) >= own or 2 * own < free[id(root)] or article and id(node) not in inside
            if not out:  # most of the page is in here: judge what it holds by what else it holds
                rest += own - sum(free[id(x)] for x in _outer(node, is_named))
        if out:
            gone.add(id(node))
            node.parts = []
            node.tag = "#out" if node.tag not in BLOCK else "#block"


def _outer(top: Node, is_named) -> list[Node]:
    """The outermost named nodes below ``top``."""
    out, stack = [], [x for x in top.parts if isinstance(x, Node)]
    while stack:
        node = stack.pop()
        if is_named(node):
            out.append(node)
        else:
            stack.extend(x for x in node.parts if isinstance(x, Node))
    return out


def _measure(root: Node) -> list[Node]:
    nodes = _nodes(root)
    for node in reversed(nodes):
        text = sum(len(x.strip()) for x in node.parts if isinstance(x, str))
        own = [x for x in node.parts if isinstance(x, Node)]
        node.chars = text + sum(x.chars for x in own)
        node.tags = len(own) + sum(x.tags for x in own)
        node.link_tags = sum(x.link_tags + (x.tag == "a") for x in own)
        node.link_chars = node.chars if node.tag == "a" else sum(x.link_chars for x in own)
    body = next((x for x in nodes if x.tag == "body"), root)
    ratio = body.link_chars / max(body.chars, 1)
    for node in nodes:
        c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        plain = max(c - node.link_chars, 1)
        base = math.log(c / plain * node.link_chars + ratio * c + math.e)
        node.density = (DOUBT if node.doubt else 1.0) * c / t * math.log(max(c / lc * t / lt, 1.0), max(base, 1.0001)) if c else 0.0
    for node in nodes:
        node.total = sum(x.density for x in node.parts if isinstance(x, Node))
    return nodes


def main_node(root: Node) -> Node:
    nodes = _measure(root)
    body = next((x for x in nodes if x.tag == "body"), root)
    below = {id(x) for x in _nodes(body)}
    nodes = [x for x in nodes if id(x) in below and x.chars]
    if not nodes:
        return body
    densest = max(nodes, key=lambda x: x.density)
    threshold, node = densest.density, densest
    while node is not None and id(node) in below:
        threshold = min(threshold, node.density)
        node = node.parent
    best = max((x for x in nodes if x.density >= threshold), key=lambda x: x.total)
    if not best.total:  # a text without elements
        best = densest
    # the parts of one article belong together
    node = best
    while node is not None and id(node) in below:
        if node.tag in ("article", "main"):
            return node
        node = node.parent
    while best.parent is not None and id(best.parent) in below:
        others = [x for x in best.parent.parts if isinstance(x, Node) and x is not best and x.chars]
        loose = any(isinstance(x, str) and x.strip() for x in best.parent.parts)
        alike = any(x.density >= threshold and x.link_chars < 0.3 * x.chars and (x.tag == best.tag or x.tag in ("p", "h1", "h2", "h3", "section", "blockquote", "ul", "ol", "table")) for x in others)
        if not (alike or loose or best.tag not in BLOCK):
            break
        best = best.parent
    return best


def block_text(node: Node) -> str:
    """Blocks in page order, white space inside of each as one space, joined by one space."""
    blocks, now = [], []
    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            blocks.append("".join(now))
            now = []
        elif isinstance(x, str):
            now.append(x)
        elif x.doubt and x is not node and x.link_chars > MOSTLY_LINKS * x.chars:
            now.append(" ")
        else:
            cut = x.tag in BLOCK or x.tag == "#block"
            if x.tag in ("br", "#out"):
                now.append(" ")
            stack.extend([None] * cut + x.parts[::-1] + [None] * cut)
    blocks.append("".join(now))
    return " ".join(t for t in (" ".join(b.split()) for b in blocks) if t)


def extract(source: str | None) -> str:
    if not source:
        return ""
    root = parse(source)
    _prune(root)
    return block_text(main_node(root))


def _extracted(batches):
    for batch in batches:
        for part in slices(batch, 2):
            texts = [extract(x.as_py()) for x in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """The main text of each whole page of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    Null or empty html, or a page without text, has an empty one. Null ids and urls are kept,
    repeated rows are read each; other columns are left out; no rows give none. Whole pages are
    read, however long, in time that grows with their length. One narrow pass without a shuffle."""
    bounded(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")

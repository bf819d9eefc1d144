"""Main text of web pages, by tag-path ratios.

A page's elements become a tree, and its text leaves: what stands between two borders of
block elements.  Leaves of one root-to-leaf path of block tags are taken together: text
length a leaf and punctuation a leaf are the path's ratios.  Each leaf has its path's ratios,
which are smoothed over the leaves in page order and fused to one; what reaches the page's
threshold, the standard deviation of the fused ratios, is content.  Content names the part of
the tree to keep: the article (or main) element with most of it, or, where a page has
neither, the lowest element that holds nearly all of it; inside an article nothing is
dropped but what its own elements mark as something else.

Elements that mark something else: ``nav``, ``aside``, ``footer``, ``header`` outside of an
article, buttons and what isn't text (hard marks); forms and elements with a word of
``MARKS`` in their class or id, or such a role, unless the heading or the article itself
lies within (soft marks).  ``main``, ``article``, ``html`` and ``body`` are never marked by a
word, but articles are by words for comments and teasers.  If marks leave nothing of a page, its soft ones don't count.

Parsing follows the HTML standard where it matters here: comments, raw text, quoted
attributes, end tags that are implied or missing, markup that ends with the page.

Cases: a null or empty page, or one without text, gives the empty text.  ``br`` is white
space.  Repeated pages and ties are independent rows.  A page is parsed in time linear in
its length, whatever its nesting; rows arrive in small batches.  All other columns stay.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from gradeloom.llm.shared import tidy

TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<([a-zA-Z][^\s/>]*+)((?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[^>])*+)>|</([a-zA-Z][^\s/>]*+)[^>]*+>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z""",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td
    tfoot th thead tr ul""".split()
)
#: A start tag ends an open element of these, not beyond one of those.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    **dict.fromkeys(("thead", "tbody", "tfoot"), ({"thead", "tbody", "tfoot"}, {"table"})),
}
IN_HEAD = frozenset("head title meta link style script base noscript template".split())
HEDGES = frozenset("button td th caption table object template".split())
HARD = frozenset("nav aside footer button select datalist dialog svg template noscript object canvas video audio head search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
TEASERS = frozenset("related teaser teasers promo recommended recommendations sponsored advert ad ads advertisement adsbygoogle".split())
MARKS = COMMENTS | TEASERS | frozenset(
    """nav navbar navigation menu menus sidebar sidebars widget widgets footer masthead banner adverts advertising sponsor promoted promotion cookie cookies
    consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share sharing social breadcrumb breadcrumbs
    pagination pager toolbar skip copyright disclaimer header""".split()
)
CORE = frozenset({"main", "article", "html", "body"})
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？؟।]")
#: Smoothing over neighbours in page order.
KERNEL = np.exp(-np.arange(-2, 3) ** 2 / 2.0)
#: Share of the content that an element must hold to be entered, and of main's content that an article must have.
MOST, LEAST = 0.9, 0.3


class _Page:
    """Elements (parent, path of block tags, marks) and text leaves of a page."""

    def __init__(self, source: str):
        self.parent, self.path, self.tag, self.hard, self.soft, self.kind = [-1], [0], [""], [False], [False], [0]
        self.paths: dict = {}
        self.leaves: list[tuple[int, str, int]] = []
        self.stack, self.open, self.links, self.muted = [0], {}, 0, 0
        self.pieces: list[str] = []
        self.linked = 0
        self._read(source)

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        while at < n:
            m = TOKEN.search(source, at)
            if not m:
                break
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            if m.group(1):
                name = m.group(1).lower()
                self._start(name, m.group(2))
                if name in RAW:
                    end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                    at = end.start() if end else n
            elif m.group(3):
                self._end(m.group(3).lower())
        if at < n:
            self._text(source[at:])
        self._flush()

    def _text(self, text: str) -> None:
        if self.muted:
            return  # part of a line that goes, the line stays
        if "&" in text:
            text = html.unescape(text)
        if self.open.get("head") and not text.isspace() and self.tag[self.stack[-1]] == "head":
            self._end("head")
        self.pieces.append(text)
        if self.links:
            self.linked += len(text)

    def _flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.leaves.append((self.stack[-1], text, min(self.linked, len(text))))
            self.pieces, self.linked = [], 0

    def _start(self, name: str, attributes: str) -> None:
        block = name in BLOCKS
        if self.open.get("head") and name not in IN_HEAD:
            self._end("head")
        if block:
            self._flush()
            if self.open.get("p"):
                self._pop_to({"p"}, HEDGES)
            if name in ENDS and any(self.open.get(t) for t in ENDS[name][0]):
                self._pop_to(*ENDS[name])
        if name == "br":
            self.pieces.append(" ")
        if name in VOID:
            return
        node, above = len(self.parent), self.stack[-1]
        self.parent.append(above)
        self.path.append(self.paths.setdefault((self.path[above], name), len(self.paths) + 1) if block else self.path[above])
        self.tag.append(name)
        hard, soft, kind = self._marks(name, attributes)
        self.hard.append(hard)
        self.soft.append(soft)
        self.kind.append(kind)
        self.stack.append(node)
        self.open[name] = self.open.get(name, 0) + 1
        self.links += name == "a"
        self.muted += not block and (hard or soft)

    def _marks(self, name: str, attributes: str) -> tuple[bool, bool, int]:
        """Hard and soft mark, and kind: 1 a heading or main element, 2 an article."""
        words, roles, props = set(), set(), set()
        if "=" in attributes:
            for key, *values in ATTRIBUTE.findall(attributes):
                key = key.lower()
                if key in ("class", "id"):
                    words.update(w.lower() for w in WORD.findall("".join(values)))
                elif key in ("role", "itemprop"):
                    (roles if key == "role" else props).update("".join(values).lower().split())
        within = self.open.get("article") or self.open.get("main")
        hard = name in HARD or name in RAW or name == "header" and not within or bool(roles & ROLES)
        marks = (COMMENTS | TEASERS) if name == "article" else frozenset() if name in CORE or "main" in roles else MARKS
        if within and name != "article":
            marks = marks - {"header"}
        soft = name == "form" or bool(words & marks)
        kind = 3 if soft and words & COMMENTS else 1 if name in ("h1", "main") or "main" in roles else 2 if name == "article" or "article" in roles or "articlebody" in props else 0
        return hard, soft, kind

    def _pop_to(self, names: set | frozenset, hedges: set | frozenset) -> None:
        """Ends the innermost open element of these names, if none of the hedges is nearer."""
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.tag[self.stack[k]]
            if tag in names:
                self._cut(k)
                return
            if tag in hedges:
                return

    def _end(self, name: str) -> None:
        if name in BLOCKS:
            self._flush()
        if self.open.get(name):
            k = len(self.stack) - 1
            while self.tag[self.stack[k]] != name:
                k -= 1
            self._cut(k)

    def _cut(self, k: int) -> None:
        for node in self.stack[k:]:
            self.open[self.tag[node]] -= 1
            self.links -= self.tag[node] == "a"
            self.muted -= self.tag[node] not in BLOCKS and (self.hard[node] or self.soft[node])
        del self.stack[k:]


def _kept(page: _Page, soft: bool = True) -> np.ndarray:
    """Whether no mark drops a node; soft marks don't count if so told."""
    n = len(page.parent)
    core = [False] * n  # holds the heading or the main element
    whole = [False] * n  # holds an article that no word marks
    for k in range(n - 1, 0, -1):
        up = page.parent[k]
        core[up] = core[up] or core[k] or page.kind[k] == 1
        whole[up] = whole[up] or whole[k] or page.kind[k] == 2 and not page.soft[k]
    kept = [True] * n
    for k in range(1, n):
        marked = page.hard[k] or soft and page.soft[k] and not (core[k] or whole[k] and page.kind[k] != 3)
        kept[k] = kept[page.parent[k]] and not marked
    return np.array(kept)


def ratios(paths: np.ndarray, chars: np.ndarray, punctuation: np.ndarray) -> np.ndarray:
    """Fused and smoothed path ratios of leaves in page order."""
    _, of, leaves = np.unique(paths, return_inverse=True, return_counts=True)
    fused = np.ones(len(paths))
    for amount in (chars, punctuation + 1):
        each = (np.bincount(of, amount) / leaves)[of]
        weight = np.convolve(np.ones(len(each)), KERNEL)[2:-2]
        fused *= np.convolve(each, KERNEL)[2:-2] / weight
    return fused


def main_text(source: str | None) -> str:
    """The article of a page: its blocks, in page order, one a line."""
    if not source:
        return ""
    page = _Page(source)
    for soft in (True, False):  # words may mark all of a page: then they tell nothing
        kept = _kept(page, soft)
        if leaves := [x for x in page.leaves if kept[x[0]]]:
            break
    else:
        return ""
    nodes, chars = np.array([x[0] for x in leaves]), np.array([len(x[1]) for x in leaves], np.int64)
    linked = np.array([x[2] for x in leaves], np.int64)
    fused = ratios(np.array(page.path)[nodes], chars - linked, np.array([len(PUNCTUATION.findall(x[1])) for x in leaves], np.int64))
    content = (fused >= fused.std()) & (2 * linked < chars)
    first, last = _spans(page)
    inside = lambda k: (nodes >= first[k]) & (nodes < last[k])
    held = _held(page, nodes, np.where(content, chars, 0))
    texts = _held(page, nodes, chars)
    named = [k for k in range(1, len(page.parent)) if kept[k] and texts[k] and (page.kind[k] == 2 or page.kind[k] == 1 and page.tag[k] != "h1")]
    if named:
        # the article with most of the content, the outermost of equals, unless main has far more
        best = lambda some: max(some, key=lambda k: (held[k], texts[k], -k), default=0)
        article, main = (best([k for k in named if page.kind[k] == kind]) for kind in (2, 1))
        root = article if article and (held[article] >= LEAST * held[main] or not main) else main
        chosen = inside(root)
    else:
        root = 0
        while down := [k for k in _children(page, root) if held[k] >= MOST * held[root] > 0]:
            root = down[0]
        chosen = inside(root)
        if content.any():
            # lines before and after the content are not of it, but for headings
            like, where = np.isin(np.array(page.path)[nodes], np.array(page.path)[nodes[content]]), np.flatnonzero(content & chosen)
            heads = np.array([any(page.tag[k] == f"h{n}" for n in range(1, 7)) for k in nodes.tolist()])
            start, end = where[0], where[-1]
            while start and (heads[start - 1] or like[start - 1] and 2 * linked[start - 1] < chars[start - 1]) and chosen[start - 1]:
                start -= 1
            while end + 1 < len(nodes) and like[end + 1] and 2 * linked[end + 1] < chars[end + 1] and chosen[end + 1]:
                end += 1
            chosen &= (np.arange(len(nodes)) >= start) & (np.arange(len(nodes)) <= end)
    return "\n".join(x[1] for x, c in zip(leaves, chosen.tolist(), strict=True) if c)


def _spans(page: _Page) -> tuple[np.ndarray, np.ndarray]:
    """Nodes are numbered in page order: a node's descendants are from it up to before its last."""
    n = len(page.parent)
    last = np.arange(1, n + 1)
    for k in range(n - 1, 0, -1):
        last[page.parent[k]] = max(last[page.parent[k]], last[k])
    return np.arange(n), last


def _held(page: _Page, nodes: np.ndarray, amount: np.ndarray) -> list[int]:
    """Sum of the leaves' amounts below each node."""
    out = np.bincount(nodes, amount, len(page.parent)).astype(np.int64).tolist()
    for k in range(len(out) - 1, 0, -1):
        out[page.parent[k]] += out[k]
    return out


def _children(page: _Page, node: int) -> list[int]:
    if not hasattr(page, "below"):
        page.below = {}
        for k in range(1, len(page.parent)):
            page.below.setdefault(page.parent[k], []).append(k)
    return page.below.get(node, [])


def _texts(batches):
    for b in batches:
        found = pa.array([main_text(x) for x in b.column("html").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*b.columns, found], names=[*b.schema.names, "main_text"])


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (html string and any other columns) with main_text, never null."""
    schema = StructType([*(f for f in pages.schema if f.name != "main_text"), StructField("main_text", StringType())])
    return pages.drop("main_text").mapInArrow(tidy(_texts), schema)

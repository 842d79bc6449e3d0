"""Main text of web pages by wrapper induction over the pages of a host.

Pages of a host that have the same kinds of structural elements and start with the same one are a layout, and each layout
has a reference page, of which only the tree is kept; layouts of one page are put to the host's commonest. Every page of a layout is aligned with its
reference by simple tree matching, the ordered matching of two DOM trees with most nodes in common. Each text of the
reference counts the pages that have a text in its place, the values there and the commonest one; each container counts
the pages in which it has the same shape, and the text that pages have in it beyond the reference. Pages whose text,
without what is marked as no content, is equal are copies and have one vote together; every other page counts.

``judge`` makes the wrapper of a layout from these counts alone:

* texts that stay the same on most pages, or are drawn from few values, are template; the places that vary are slots;
* containers whose text is links, and lists of records that repeat one fixed label, are furniture (menus, teasers, replies);
* from the root down, the container with more than half of the varying text holds the article. What stands beside it, small
  and of one shape on nearly all pages, is a field of the template (adverts, notices, footers with changing text) if it has
  links, a fixed label or a name that says so, or comes before the box with the page's title, and so is what only single
  pages have there. Other prose, text blocks and headings beside it stay.

A wrapper decides over names and kinds of elements: what holds the article is never skipped, whatever its class says, and
furniture is, whatever it is called. Marks (HTML's sectioning elements, roles, words in class names) break ties: what the
page itself calls its article bounds it where both agree on the place; and they decide inside the
article, where no container has most of the text or fewer than three pages differ, and where a page has no counterpart of
the article's place. Hosts of one page (copies counted once), and pages of no host, have marks only.

Plan: the references are one row per host and layout, chosen by minima that are combined before the shuffle. Pages are
joined with them by host and layout, each page gives one row of votes, of which copies keep one, and the pages are joined with the wrappers
the same way; a hot host is a skewed join of plain tables, which AQE splits. No task holds more than a batch of pages.
"""

from __future__ import annotations

import html as html_module
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch

# HTML's element kinds, and names that mark what is no content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow msub msup msubsup mfrac msqrt mroot munder mover munderover mstyle semantics".split())
NO_CONTENT = frozenset(
    "head title script style noscript template svg annotation annotation-xml iframe object canvas audio video map nav header footer aside form fieldset button select option input textarea label menu dialog".split()
)
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = frozenset("ul ol dl table article section div body main nav aside header footer".split())
MARKS = frozenset(
    """ad ads adv advert adverts advertisement advertising adbox adsense banner banners sponsor sponsored promo promotion nav navbar navigation
    menu menus menubar submenu breadcrumb breadcrumbs sidebar sidebars side aside footer foot header masthead topbar cookie cookies consent gdpr
    notice notices alert alerts warning popup modal overlay newsletter subscribe subscription signup share sharing social related recommended
    recommendations trending comment comments discussion respond reply replies disqus pagination pager widget widgets toolbar login search form
    copyright legal skip""".split()
)
MAIN = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
BODY_MARKS = frozenset("article articlebody content main post entry story".split())
ASIDES = frozenset("comment comments reply related promo promoted sponsored ad ads advert advertisement teaser".split())
LAYOUT = "div section main article nav header footer aside table form".split()
# Elements that never hold article text, and those that hold a line or block of it.
HARD = frozenset("head title script style noscript template svg annotation annotation-xml iframe object canvas audio video map form fieldset button select option input textarea label menu dialog".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl li dt dd table caption thead tbody tfoot tr td th figure figcaption address details summary hr br img picture".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")


class Node:
    """An element (tag, children) or a text (tag "#", text). ``shape`` numbers its tree of tags."""

    __slots__ = ("tag", "children", "text", "shape", "skip", "main", "body", "named")

    def __init__(self, tag: str, text: str = "", skip: bool = False):
        self.tag, self.text, self.skip = tag, text, skip
        self.main = self.body = self.named = False
        self.children: list[Node] = []
        self.shape = 0


def _names(value: str) -> set[str]:
    return {x.lower() for x in _NAME.findall(value)}


class _Open:
    """The open elements, with counts that save walking them: a page may be nested as deep as it is long."""

    def __init__(self, root: Node):
        self.nodes, self.count, self.mains = [root], Counter(), 0
        self.named: list[Node] = []  # the open ones that only a class or id skips

    def push(self, node: Node) -> None:
        self.nodes.append(node)
        self.count[node.tag] += 1
        self.mains += node.main
        if node.named:
            self.named.append(node)

    def cut(self, k: int) -> None:
        while len(self.nodes) > k:
            node = self.nodes.pop()
            self.count[node.tag] -= 1
            self.mains -= node.main
            if node.named:
                self.named.pop()

    def close(self, tags: set[str], stop: frozenset[str]) -> None:
        """Ends the nearest open element of ``tags``, unless one of ``stop`` is nearer."""
        if any(self.count[t] for t in tags):
            for k in range(len(self.nodes) - 1, 0, -1):
                if self.nodes[k].tag in tags:
                    return self.cut(k)
                if self.nodes[k].tag in stop:
                    return None
        return None


def parse(page: str) -> Node:
    """The DOM tree; unclosed elements end where HTML ends them, or with their parent. A class or id does not skip what
    holds the page's main or only articles, nor all that the page has. A form that holds them, or most of the page's
    text, is a box like any other."""
    root = Node("#root")
    stack, at, length = _Open(root), 0, len(page)
    named: list[Node] = []  # what only a class or id skips
    articles: list[list[Node]] = []  # of each article inside such a node, these nodes
    forms: list[Node] = []

    def add(text: str) -> None:
        if stack.nodes[-1].tag == "head" and not text.isspace():
            stack.cut(len(stack.nodes) - 1)
        inside = stack.nodes[-1].children
        if text and not text.isspace():
            inside.append(Node("#", html_module.unescape(text)))
        elif text and inside and inside[-1].tag == "#":
            inside[-1].text += " "
        elif text:
            inside.append(Node("#", " "))

    while at < length:
        m = _TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m.group(2)
        if not name:
            continue
        tag = name.lower()
        if m.group(1):
            stack.close({tag}, CONTAINERS if tag in INLINE else frozenset())
            continue
        attributes = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(m.group(3))} if m.group(3).strip(" /") else {}
        if stack.nodes[-1].tag == "head" and tag not in IN_HEAD:
            stack.cut(len(stack.nodes) - 1)
        if tag in CLOSES_P:
            stack.close({"p"}, CONTAINERS)
        if tag in CLOSED_BY:
            stack.close(CLOSED_BY[tag], CONTAINERS)
        names = _names(f"{attributes.get('class', '')} {attributes.get('id', '')}") if attributes else set()
        inside = stack.mains > 0
        by_name = bool(names & MARKS)
        marked = attributes.get("role", "").lower() in ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        heading = inside and (tag == "header" or names & MARKS == {"header"})
        if tag == "article":
            marked, by_name = bool(names & ASIDES), False
        node = Node(tag, skip=(tag in NO_CONTENT or marked or by_name) and tag not in ("html", "body", "main") and not heading)
        node.body = bool(names & BODY_MARKS)
        node.main = not inside and (tag in MAIN or attributes.get("role", "").lower() == "main" or attributes.get("itemprop", "").lower() == "articlebody")
        node.named = node.skip and by_name and not marked and tag not in NO_CONTENT
        if node.named:
            named.append(node)
        if stack.named and not node.skip and (tag in MAIN or node.main):
            if tag == "article":
                articles.append(list(stack.named))
            else:
                for x in stack.named:
                    x.skip = False
        if tag == "form":
            forms.append(node)
        stack.nodes[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = page.find(">", end.end()) + 1 or length if end else length
        elif tag not in VOID and not m.group(3).endswith("/"):
            stack.push(node)
    if forms:
        _open_forms(root, forms)
    if articles and (not _outermost(root, "main") or not _shows(root)):
        for over in articles:
            for x in over:
                x.skip = False
    if named and not _shows(root):
        for x in named:
            x.skip = False
    return root


def _open_forms(root: Node, forms: list[Node]) -> None:
    """Makes boxes of the forms that hold a main element or more than half of the page's text."""
    kept = [(x.tag, x.skip) for x in forms]
    for x in forms:
        x.tag, x.skip = "div", False
    whole = _plain([root])
    for x, (tag, skip) in zip(forms, kept, strict=True):
        if 2 * _plain([x]) <= whole and not _outermost(x, "main"):
            x.tag, x.skip = tag, skip


def nodes_of(root: Node) -> list[Node]:
    """All nodes of a tree in page order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed(node.children))
    return out


class Matcher:
    """Simple tree matching with the weights of pairs of shapes remembered; the memory is emptied when it is full.

    A pair of shapes nested deeper than ``depth``, or standing in lists of more than ``pairs`` unlike pairs, has as its
    weight the bound of it that their sizes give, so that time stays in bounds; every node is aligned all the same."""

    limit, depth, pairs, cells = 200_000, 60, 40_000, 4_000_000

    def __init__(self) -> None:
        self.shapes: dict[tuple, int] = {}
        self.tags: list[str] = []
        self.parts: list[tuple[int, ...]] = []
        self.sizes: list[int] = []
        self.depths: list[int] = []
        self.weights: dict[tuple[int, int], int] = {}

    def shape(self, root: Node) -> int:
        """Numbers the shapes of ``root`` and all below it."""
        for node in reversed(nodes_of(root)):
            key = (node.tag, tuple(c.shape for c in node.children))
            found = self.shapes.get(key)
            if found is None:
                found = self.shapes[key] = len(self.tags)
                self.tags.append(key[0])
                self.parts.append(key[1])
                self.sizes.append(1 + sum(self.sizes[c] for c in key[1]))
                self.depths.append(1 + max((self.depths[c] for c in key[1]), default=0))
            node.shape = found
        return root.shape

    def full(self) -> bool:
        return len(self.tags) > self.limit or len(self.weights) > 4 * self.limit

    def weight(self, a: int, b: int) -> int:
        """The nodes of a greatest matching of two shapes that keeps roots, order and ancestors."""
        if a == b:
            return self.sizes[a]
        if self.tags[a] != self.tags[b]:
            return 0
        found = self.weights.get((a, b))
        if found is None:
            if min(self.depths[a], self.depths[b]) > self.depth:
                found = min(self.sizes[a], self.sizes[b])
            else:
                p, q = self.parts[a], self.parts[b]
                found = 1 + (int(self._last(*self._pairs(p, q))[-1]) if len(p) * len(q) > 400 else self._small(p, q)[-1][-1])
            self.weights[a, b] = found
        return found

    def _small(self, a: tuple[int, ...], b: tuple[int, ...]) -> list[list[int]]:
        row = [0] * (len(b) + 1)
        rows = [row]
        for x in a:
            new, best = [0], 0
            for j, y in enumerate(b):
                best = max(best, row[j + 1], row[j] + self.weight(x, y))
                new.append(best)
            row = new
            rows.append(row)
        return rows

    def _pairs(self, p: tuple[int, ...], q: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weights of the unlike shapes of two lists, and where each list's members stand in that table."""
        u, i = np.unique(np.asarray(p), return_inverse=True)
        v, j = np.unique(np.asarray(q), return_inverse=True)
        if len(u) * len(v) <= self.pairs:
            return np.array([[self.weight(x, y) for y in v.tolist()] for x in u.tolist()], np.int64), i, j
        names = {t: n for n, t in enumerate(dict.fromkeys(self.tags[x] for x in (*u, *v)))}
        a, b = (np.array([names[self.tags[x]] for x in w]) for w in (u, v))
        size_a, size_b = (np.array([self.sizes[x] for x in w], np.int64) for w in (u, v))
        return np.where(a[:, None] == b, np.minimum(size_a[:, None], size_b), 0), i, j

    @staticmethod
    def _last(w: np.ndarray, i: np.ndarray, j: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Last row of the table of greatest ordered matchings; all rows go to ``keep`` if given."""
        row = np.zeros(len(j) + 1, np.int64)
        for x in i:
            new = np.maximum(row[1:], row[:-1] + w[x][j])
            row = np.concatenate(([0], np.maximum.accumulate(new)))
            if keep is not None:
                keep.append(row)
        return row

    def partners(self, p: tuple[int, ...], q: tuple[int, ...]) -> list[tuple[int, int]]:
        """Places in two lists of shapes that a greatest ordered matching pairs. Long lists are halved until a table
        of them fits."""
        out: list[tuple[int, int]] = []

        def back(t, m: int, n: int, a: int, b: int) -> None:
            while m and n:
                if t[m][n] == t[m - 1][n]:
                    m -= 1
                elif t[m][n] == t[m][n - 1]:
                    n -= 1
                else:
                    m, n = m - 1, n - 1
                    out.append((a + m, b + n))

        if len(p) * len(q) <= 400:
            back(self._small(p, q), len(p), len(q), 0, 0)
            return out
        w, i, j = self._pairs(p, q)
        parts = [(0, len(p), 0, len(q))]
        while parts:
            a, a_end, b, b_end = parts.pop()
            if a == a_end or b == b_end:
                continue
            if (a_end - a) * (b_end - b) <= self.cells or a_end - a == 1:
                rows = [np.zeros(b_end - b + 1, np.int64)]
                self._last(w, i[a:a_end], j[b:b_end], rows)
                back(rows, a_end - a, b_end - b, a, b)
            else:
                half = (a + a_end) // 2
                ahead, behind = self._last(w, i[a:half], j[b:b_end]), self._last(w, i[half:a_end][::-1], j[b:b_end][::-1])
                cut = b + int(np.argmax(ahead + behind[::-1]))
                parts += [(a, half, b, cut), (half, a_end, cut, b_end)]
        return out

    def align(self, a: Node, b: Node) -> Iterator[tuple[Node, Node, list[Node]]]:
        """Pairs of nodes in the same place of both trees, whose roots match, and the second's children without a
        partner."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            x, y = a.children, b.children
            if a.shape == b.shape:
                yield a, b, []
                todo.extend(zip(x, y))
                continue
            i, j, end_i, end_j = 0, 0, len(x), len(y)
            while i < end_i and j < end_j and x[i].shape == y[j].shape:  # alike at both ends: no table is needed for these
                todo.append((x[i], y[j]))
                i, j = i + 1, j + 1
            while end_i > i and end_j > j and x[end_i - 1].shape == y[end_j - 1].shape:
                end_i, end_j = end_i - 1, end_j - 1
                todo.append((x[end_i], y[end_j]))
            rest = y[j:end_j]
            if i < end_i and j < end_j:
                found = self.partners(tuple(c.shape for c in x[i:end_i]), tuple(c.shape for c in rest))
                todo.extend((x[i + m], rest[n]) for m, n in found)
                paired = {n for _, n in found}
                rest = [c for n, c in enumerate(rest) if n not in paired]
            yield a, b, rest


def _outermost(root: Node, mark: str) -> list[Node]:
    """The nodes with a mark that lie in no other such node and in nothing that is skipped."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.skip:
            continue
        if getattr(node, mark):
            out.append(node)
        else:
            stack.extend(reversed(node.children))
    return out


def _shows(root: Node) -> bool:
    """Whether ``content`` finds any text."""
    stack = _outermost(root, "main") or [root]
    while stack:
        node = stack.pop()
        if node.tag == "#":
            if not node.text.isspace():
                return True
        elif not node.skip:
            stack.extend(node.children)
    return False


def _text(tops: list[Node], template: set[int] | frozenset[int]) -> str:
    parts: list[str] = []
    stack: list[Node | None] = [x for top in reversed(tops) for x in (None, top)]  # None stands for a space
    while stack:
        node = stack.pop()
        if node is None:
            parts.append(" ")
        elif node.tag == "#":
            if id(node) not in template:
                parts.append(node.text)
        elif not node.skip:
            if node.tag not in INLINE:
                parts.append(" ")
                stack.append(None)
            stack.extend(reversed(node.children))
    return " ".join("".join(parts).split())


def content(root: Node, template: set[int] | frozenset[int] = frozenset()) -> str:
    """Text of the slots of the page's article, without what is no content; blocks are joined by one space.

    ``template`` holds the ids of text nodes that belong to the template. Where no element is an article, those named
    like one are taken if they hold half of what the page's slots hold, and else the whole page."""
    if tops := _outermost(root, "main"):
        return _text(tops, template)
    whole = _text([root], template)
    if tops := _outermost(root, "body"):
        named = _text(tops, template)
        if 2 * len(named) >= len(whole):
            return named
    return whole


def host() -> Column:
    """Host of the URL in lower case, "" if it has none."""
    return F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def layout() -> Column:
    """Which of LAYOUT occur in the page, and the first element of its body."""
    page = F.lower("html")
    kinds = F.concat(*(F.when(F.contains(page, F.lit(f"<{t}")), "1").otherwise("0") for t in LAYOUT))
    return F.concat(kinds, F.regexp_extract(page, r"<body[^>]*>\s*<([a-z]+)", 1))


def _key() -> Column:
    return F.xxhash64("page_id", "url", "html")


def _digest(root: Node) -> int:
    return _value(content(root))


def _value(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63) or 1


def _plain(tops: list[Node]) -> int:
    """Characters of text outside links and elements that never hold any."""
    total, stack = 0, list(tops)
    while stack:
        node = stack.pop()
        if node.tag == "#":
            total += len(node.text.strip())
        elif node.tag != "a" and node.tag not in HARD:
            stack.extend(node.children)
    return total


def _container(node: Node) -> bool:
    return node.tag != "#" and node.tag not in INLINE and node.tag not in BLOCKS and node.tag not in HARD


def skeleton(root: Node, marks: dict[int, int] | None = None) -> str:
    """A tree without its texts, with the marks of a wrapper: a line per node in page order with tag, number of children,
    whether it is skipped (s) and what the page calls its article (m), and the mark. It is a small part of a page."""
    lines = []
    for k, x in enumerate(nodes_of(root)):
        mark = marks.get(k) if marks else None
        line = x.tag if x.tag == "#" else f"{x.tag} {len(x.children)} {'s' * x.skip}{'m' * x.main}"
        lines.append(line if mark is None else f"{line} ={mark}")
    return "\n".join(lines)


def regrown(text: str) -> tuple[Node, dict[int, int]]:
    """The tree of a skeleton, and its marks by the nodes' numbers."""
    root, marks = Node("#root"), {}
    open_: list[tuple[Node, int]] = []
    for k, line in enumerate(text.split("\n")):
        tag, *rest = line.split(" ")
        if rest and rest[-1].startswith("="):
            marks[k] = int(rest.pop()[1:])
        node = Node(tag)
        if k:
            parent, left = open_.pop()
            parent.children.append(node)
            if left > 1:
                open_.append((parent, left - 1))
        else:
            root = node
        if tag != "#":
            node.skip, node.main = "s" in rest[1], "m" in rest[1]
            if int(rest[0]):
                open_.append((node, int(rest[0])))
    return root, marks


class Pages:
    """Parsing pages and aligning them with references, whose trees are kept; all is forgotten when memory is full."""

    limit = 200_000

    def __init__(self) -> None:
        self.matcher, self.held, self.known = Matcher(), 0, {}

    def reference(self, text: str) -> tuple[Node, dict[int, int], dict[int, int], set[int]]:
        """Of a skeleton the tree, the numbers of its nodes by their ids, the marks, and the ids of texts that stand in a
        container themselves, outside any block."""
        if self.matcher.full() or self.held > self.limit:
            self.matcher, self.held, self.known = Matcher(), 0, {}
        found = self.known.get(text)
        if found is None:
            tree, marks = regrown(text)
            self.matcher.shape(tree)
            nodes = nodes_of(tree)
            bare = {id(c) for x in nodes if _container(x) for c in x.children if c.tag == "#"}
            found = self.known[text] = (tree, {id(x): k for k, x in enumerate(nodes)}, marks, bare)
            self.held += len(found[1])
        return found

    def tree(self, source: str) -> Node:
        tree = parse(source)
        self.matcher.shape(tree)
        return tree


def votes_of(pages: Pages, reference: str, page: str) -> tuple[int, list[int], list[int], list[int]]:
    """Digest of a page's text, and its votes: places of the reference with, for a text, its value and length, and for
    an element, whether it has the reference's shape (1 or 0) and the plain characters of children without a partner. The
    place -1 - k is the first word of a text k that stands in a container itself."""
    model, at, _, bare = pages.reference(reference)
    tree = pages.tree(page)
    copy = _digest(tree)
    places, values, sizes = [], [], []
    for a, b, rest in pages.matcher.align(model, tree):
        if a.tag == "#":
            if not (text := b.text.strip()):
                continue
            value, size = _value(text), len(text)
            if id(a) in bare:
                places.append(-1 - at[id(a)])
                values.append(_value(text.split(maxsplit=1)[0]))
                sizes.append(0)
        elif a.tag in HARD:
            continue
        else:
            size = _plain(rest) if rest else 0
            if not size and not _container(a):
                continue
            value = int(a.shape == b.shape)
        places.append(at[id(a)])
        values.append(value)
        sizes.append(size)
    return copy, places, values, sizes


def _rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Rows of a batch, one at a time."""
    return zip(*((x.as_py() for x in batch.column(c)) for c in names), strict=True)


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = pa.array([skeleton(parse(x)) for (x,) in _rows(batch, "html")], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("of"), text], ["host", "of", "reference"])


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, copy, places, values, sizes): the votes of each page. unit is a hash of host and layout, and copy one of the
    page's text, so that millions of votes are counted by numbers."""
    pages = Pages()
    for batch in batches:
        got = [votes_of(pages, ref, page) for page, ref in _rows(batch, "html", "reference")]
        copy, places, values, sizes = zip(*got, strict=True) if got else ((), (), (), ())
        columns = [batch.column("unit"), pa.array(copy, pa.int64()), pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, ["unit", "copy", "places", "values", "sizes"])


# What a wrapper says of an element.
FURNITURE, ABOVE, ARTICLE = 1, 2, 3


def judge(root: Node, counts: dict[int, tuple[int, int, int, int, int, int]], share: float = 0.8, small: float = 0.1, least: int = 3) -> dict[int, int]:
    """The wrapper of a layout: of nodes of its reference, by their numbers in page order, a text's template value (0 for
    any value), or FURNITURE, ABOVE (holds the article) or ARTICLE of an element.

    ``counts`` has of a place the pages (copies once), the distinct values, how many have the commonest, that value, the
    characters on all pages, and the pages of the reference's shape. A text is template where ``share`` of the pages have
    one value (all, where they are fewer than six), or where its values are a tenth of the pages; containers are judged
    where ``least`` pages vote."""
    Matcher().shape(root)
    nodes = nodes_of(root)
    n = len(nodes)
    number = {id(x): k for k, x in enumerate(nodes)}
    parent, linked, within = [-1] * n, [False] * n, [False] * n
    mains_above = [0] * n  # what the page calls its article, from the root to a node
    out: dict[int, int] = {}
    varying, links, plain, n_links = ([0] * n for _ in range(4))
    held = [x.main for x in nodes]  # whether what the page calls its article is in an element
    titled = [False] * n  # whether a varying heading of the page is in an element
    labels: list[set[int]] = [set() for _ in range(n)]  # the template values in an element
    speaks = [False] * n  # whether a template text, or one that begins with a fixed word, is in an element
    for k, x in enumerate(nodes):
        mains_above[k] += x.main
        for c in x.children:
            j = number[id(c)]
            parent[j] = k
            linked[j] = linked[k] or x.tag == "a"
            within[j] = within[k] or x.main
            mains_above[j] = mains_above[k]
    for k in range(n - 1, -1, -1):  # below come after above
        x, up = nodes[k], parent[k]
        pages, distinct, top, value, size, same = counts.get(k, (0, 0, 0, 0, 0, 0))
        if x.tag == "#":
            if pages >= 2 and top - 1 >= share * (pages - 1):
                out[k] = value
                labels[k].add(value)
            elif pages >= 10 and 10 * distinct <= pages:
                out[k] = 0
            elif not linked[k]:
                varying[k] = size
            links[k], plain[k] = (size, 0) if linked[k] else (0, size)
            seen, _, first, *_ = counts.get(-1 - k, (0, 0, 0))
            speaks[k] = k in out or (seen >= least and first >= share * seen)
        elif x.tag not in HARD:
            varying[k] += size
            plain[k] += size
            n_links[k] += x.tag == "a"
            titled[k] = titled[k] or (x.tag == "h1" and varying[k] > 0)
            # Lists of links inside the article are its references; only those around it are menus.
            menu = pages >= 2 and not within[k] and (_container(x) or x.tag in ("ul", "ol", "table", "dl"))
            if menu and links[k] >= 0.7 * (links[k] + plain[k]) and n_links[k] >= 3:
                out[k] = FURNITURE
            elif pages >= least and _container(x) and not held[k]:
                alike = Counter(c.shape for c in x.children if c.tag != "#").most_common(1)
                if alike and alike[0][1] >= 2 and 2 * alike[0][1] > sum(c.tag != "#" for c in x.children):
                    records = [number[id(c)] for c in x.children if c.shape == alike[0][0]]
                    if varying[k] and set.intersection(*(labels[c] for c in records)):
                        out[k] = FURNITURE
            if out.get(k) == FURNITURE:
                varying[k] = 0
            below = [labels[number[id(c)]] for c in x.children]
            if below:  # the greatest set takes the others in, so that depth costs nothing
                most_labels = max(below, key=len)
                for other in below:
                    if other is not most_labels:
                        most_labels |= other
                labels[k] = most_labels
        else:
            varying[k] = links[k] = plain[k] = n_links[k] = 0
            continue
        if up >= 0:
            varying[up] += varying[k]
            links[up] += links[k]
            plain[up] += plain[k]
            n_links[up] += n_links[k]
            held[up] = held[up] or held[k]
            titled[up] = titled[up] or titled[k]
            speaks[up] = speaks[up] or speaks[k]
    mains_before = np.concatenate([[0], np.cumsum([x.main for x in nodes])]).tolist()
    end = list(range(n))  # last number inside each node
    for k in range(n - 1, 0, -1):
        end[parent[k]] = max(end[parent[k]], end[k])
    marked = lambda k: mains_before[end[k] + 1] - mains_before[k]
    # A box beside the article is a field of the template where something speaks for it: links, a label, its name, that it
    # comes before the box with the page's title, or that the page calls the other box its article, or no content (then
    # names say nothing here). Prose that varies between the title and the end is article.
    evident = [bool(links[k] or n_links[k] or speaks[k] or nodes[k].skip) for k in range(n)]
    at, path = 0, []
    while True:
        kids = [number[id(c)] for c in nodes[at].children if c.tag != "#"]
        boxes = [k for k in kids if _container(nodes[k]) and out.get(k) != FURNITURE]
        big = max(boxes, key=lambda k: varying[k], default=-1)
        most = big >= 0 and 2 * varying[big] > varying[at] and counts.get(big, (0,))[0] >= least
        lines = sum(varying[k] for k in kids if nodes[k].tag in BLOCKS)
        around = mains_above[big] - (mains_above[parent[at]] if at else 0) if big >= 0 else 0
        if most and marked(at) and not marked(big) and not around:
            return out  # the page calls something else its article
        ends = nodes[at].main and nodes[at].tag != "main"  # a main element may hold more than the article
        if not ends and (most or 2 * lines > varying[at] > 0):
            for k in boxes:
                pages, same = counts.get(k, (0,) * 6)[0], counts.get(k, (0,) * 6)[5]
                title = titled[k] and not nodes[k].skip
                if (k != big or not most) and (evident[k] or (most and ((titled[big] and k < big) or nodes[big].tag == "article" or nodes[big].skip))):
                    if pages >= least and same >= share * pages and varying[k] <= small * varying[at] and not title and not marked(k):
                        out[k] = FURNITURE
        if not most or ends:
            break
        path.append(big)
        at = big
    for k in path:
        out[k] = ABOVE
    if path:
        out[path[-1]] = ARTICLE
    return out


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wrapper of each layout by its counts: the reference's skeleton with marks; null where it has none."""
    for batch in batches:
        out = []
        for ref, counts in _rows(batch, "reference", "counts"):
            root, _ = regrown(ref)
            found = judge(root, {c["place"]: (c["pages"], c["distinct"], c["top"], c["value"], c["size"], c["same"]) for c in counts})
            out.append(skeleton(root, found) if found else None)
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("of"), pa.array(out, pa.string())], ["host", "of", "wrapper"])


def text_by(pages: Pages, page: str, wrapper: str | None) -> str:
    """Text of a page by the wrapper of its layout."""
    if wrapper is None:
        return content(parse(page))
    model, at, marks, _ = pages.reference(wrapper)
    tree = pages.tree(page)
    template, article = set(), None
    beside: list[Node] = []  # what stands beside the article's place on this page only
    for a, b, rest in pages.matcher.align(model, tree):
        mark = marks.get(at[id(a)])
        if a.tag == "#":
            if mark is not None and (mark == 0 or mark == _value(b.text.strip())):
                template.add(id(b))
            continue
        if rest and (mark == ABOVE or a.tag in ("#root", "html", "body")) and mark != ARTICLE:
            beside += rest
        if mark == FURNITURE:
            b.skip = True
        elif mark is not None:
            b.skip = False
            if mark == ARTICLE:
                article = b
    if article is None:
        return content(tree, template)
    for x in beside:
        x.skip = x.skip or _container(x)
    if _outermost(tree, "main"):
        return content(tree, template)
    return _text([tree], template) or content(parse(page))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pages = Pages()
    for batch in batches:
        out = [text_by(pages, page or "", wrapper) for page, wrapper in _rows(batch, "html", "wrapper")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, one row per row of ``pages``; text is "" where there is none.

    Null html is empty; a null url or one without a host has no reference. Repeated pages and null ids are kept as they
    come; other columns are not looked at. An empty table gives an empty result. Memory is that of a batch of pages and
    their trees, however deep or wide these are.
    """
    with Scratch(pages.sparkSession, "wrapper") as scratch:
        page = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string")).withColumn("host", host()).withColumn("layout", layout())
        own = page.where("host <> '' and html is not null")
        # Rows with the same html are one page here; a host has as many layouts as there are kinds of them, not pages.
        found = own.groupBy("host", "layout", F.xxhash64("html").alias("same")).agg(F.min(_key()).alias("key"))
        found = scratch.table(found.groupBy("host", "layout").agg(F.min("key").alias("key"), F.count("*").alias("n")), "layouts")
        most = found.groupBy("host").agg(F.max(F.struct("n", "layout", "key")).alias("top"), F.sum("n").alias("all")).where(F.col("all") > 1)
        single = F.col("n") < 2
        chosen = found.join(most, "host").select("host", "layout", F.when(single, F.col("top.layout")).otherwise(F.col("layout")).alias("of"), F.when(single, F.col("top.key")).otherwise(F.col("key")).alias("key"))
        chosen = scratch.table(chosen, "chosen")
        models = own.withColumn("key", _key()).join(chosen.select("host", "of", "key").distinct(), ["host", "key"]).groupBy("host", "of").agg(F.min("html").alias("html"))
        models = scratch.table(models.mapInArrow(_skeletons, "host string, of string, reference string"), "models")
        references = scratch.table(chosen.drop("key").join(models, ["host", "of"]), "references")
        # At sight of both tables' sizes the planner broadcasts the references or sorts and splits.
        unit = F.xxhash64("host", "of").alias("unit")
        votes = own.join(references, ["host", "layout"]).select(unit, "html", "reference")
        votes = votes.mapInArrow(_votes, "unit bigint, copy bigint, places array<int>, values array<bigint>, sizes array<int>")
        votes = votes.groupBy("unit", "copy").agg(F.min(F.struct("places", "values", "sizes")).alias("v"))
        votes = votes.select("unit", F.explode(F.arrays_zip("v.places", "v.values", "v.sizes")).alias("v"))
        votes = votes.groupBy("unit", F.col("v.places").alias("place"), F.col("v.values").alias("value")).agg(F.count("*").alias("n"), F.sum("v.sizes").alias("size"))
        counts = votes.groupBy("unit", "place").agg(
            F.sum("n").alias("pages"), F.count("*").alias("distinct"), F.max(F.struct("n", "value")).alias("top"), F.sum("size").alias("size"), F.sum(F.when(F.col("value") == 1, F.col("n")).otherwise(0)).alias("same")
        )
        one = F.struct("place", "pages", "distinct", F.col("top.n").alias("top"), F.col("top.value").alias("value"), "size", "same")
        counts = counts.groupBy("unit").agg(F.collect_list(one).alias("counts"))  # at most the nodes of a page
        wrappers = models.withColumn("unit", unit).join(counts, "unit").mapInArrow(_judge, "host string, of string, wrapper string")
        wrapper = scratch.table(references.select("host", "layout", "of").join(wrappers, ["host", "of"]), "wrappers", keep=True)
    wrapper = wrapper.select(F.col("host").alias("its_host"), F.col("layout").alias("its_layout"), "wrapper")
    found = page.join(wrapper, (F.col("host") == F.col("its_host")) & (F.col("layout") == F.col("its_layout")), "left")
    return found.select("page_id", "url", "html", "wrapper").mapInArrow(_extract, "page_id bigint, url string, text string")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.withColumn("n_chars", F.char_length("text").cast("bigint"))

"""Main text of web pages by wrapper induction.

Pages of one host come from one template.  A few reference pages of a host, different in content, are aligned with the
first of them by simple tree matching (the largest order-preserving map of equal nodes, level by level).  Nodes that hold
the same text in all of them are constant and belong to the template; the others are slots.  Every page of the host is
then aligned with this wrapper: what falls on a constant node with the same text is template, varying slots are content.

What varies but is no article (menus, headers, footers, sidebars, notices, adverts, forms, comments of readers) is told
by element and by class or id, and the article is the element that says so.  Where none does, all varying slots are
content; on a host without wrapper (a single page, or copies of one), the lowest element that holds all parts with much running text.

References are at most REFS pages per host, chosen by a hash among distinct pages; the pages of a large host are dealt over
as many parts as its size asks for, each with the references, so a host with a third of all pages is no single task.

Defined cases: null or empty html gives the empty text; broken markup is read as far as it goes; a url without host forms
a host of its own name; exact copies of a reference are no evidence and are left out among the references.
"""

from __future__ import annotations

import html as html_
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from labelwise.llm.common import written

REFS = 4
PART_PAGES = 400
MAX_LARGE = 10_000
#: Pairs of children from which on their weights are made by classes; for time and memory only.
MAX_CELLS = 250_000
#: Characters from which on a block is longer than a line of a menu.
LINE = 60

# Elements by their role.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "canvas", "audio", "video", "select", "title"}
NOISE = {"nav", "header", "footer", "aside", "form", "button", "dialog", "menu", "fieldset", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
          "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
CLOSES_P = {"p", "div", "ul", "ol", "li", "h1", "h2", "h3", "h4", "h5", "h6", "table", "section", "article", "blockquote", "pre", "hr", "aside", "nav",
            "footer", "header", "main", "form", "dl", "address", "figure"}
NOISE_WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adbox", "banner", "banners", "sponsor", "sponsored", "promo",
               "promotion", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "sidebar", "side", "menu", "nav", "navbar",
               "navigation", "breadcrumb", "breadcrumbs", "comment", "comments", "disqus", "replies", "reply", "respond", "footer", "foot", "header",
               "masthead", "topbar", "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe", "subscription", "signup", "login",
               "popup", "modal", "overlay", "toolbar", "widget", "pagination", "pager", "legal", "copyright", "skip", "search", "hidden", "rail"}
#: Words that an element of the article may bear beside one that names it.
WEAK_WORDS = {"legal", "copyright", "header", "side", "foot", "search", "widget", "hidden"}
MAIN_WORDS = {"article", "content", "main", "post", "entry", "story", "body", "text"}
#: Possessive and without "<" outside quotes, so that markup without an end is passed over in linear time.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<!doctype[^<>\[]*+(?:\[[^\]]*+\])?[^<>]*+>|<[!?][^<>]*+>"
                    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S | re.I)
_ATTR = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Node:
    __slots__ = ("tag", "noise", "main", "kids", "text", "linked", "up")

    def __init__(self, tag: str, up: Node | None = None, noise: bool = False, main: int = 0):
        self.tag, self.up, self.noise, self.main = tag, up, noise, main
        self.kids: list[Node] = []
        self.text = ""
        self.linked = 0


def _roles(attrs: str) -> tuple[bool, int]:
    """Whether the class, id or role of an element names noise, and whether it names the article."""
    noise, main = False, 0
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "style":
            noise = noise or "display:none" in value.replace(" ", "").lower()
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            noise = True
        else:
            words = {w.lower() for w in _WORD.findall(value)}
            named = words & NOISE_WORDS
            noise = noise or bool(named) and not (named <= WEAK_WORDS and words & MAIN_WORDS) and not (words & {"article", "post", "entry", "story"} and not words & {"comment", "comments", "related", "ad", "share"})
            main = max(main, 2 if name == "role" and value == "main" else int(bool(words & MAIN_WORDS)))
    return noise, main


def parse(page: str) -> Node:
    """Tree of block elements; running text between block edges is a leaf of tag '#' with its white space made single."""
    root = Node("#root")
    at, buffer, now, open_inline = 0, [], root, {}  # open_inline: how often an inline element is open
    linked, on_path = 0, {}  # on_path: how often an element is open as a node

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(html_.unescape("".join(buffer)).split())
            if text:
                leaf = Node("#", now)
                leaf.text, leaf.linked = text, min(linked, len(text))
                now.kids.append(leaf)
            buffer.clear()
        linked = 0

    def leave(to: Node) -> Node:
        x = now
        while x is not to:
            on_path[x.tag] -= 1
            x = x.up
        return to

    n = len(page)
    last = max(page.rfind(mark) + 1 for mark in (">", "<!--", "<![CDATA["))  # no markup begins after this
    while at < n:
        m = _TOKEN.search(page, at) if at < last else None
        if m is None:
            buffer.append(page[at:])
            break
        if m.start() > at:
            buffer.append(page[at:m.start()])
            if open_inline.get("a"):
                linked += m.start() - at
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                buffer.append(m[0][9:-3])
            continue
        tag = tag.lower()
        if m[1]:
            if tag in INLINE:
                if open_inline.get(tag):
                    open_inline[tag] -= 1
                if now.tag == tag and now.up is not None:  # an inline element that was made a node of its own
                    flush()
                    now = leave(now.up)
                continue
            if on_path.get(tag):
                up = now
                while up.tag != tag:
                    up = up.up
                flush()
                now, open_inline = leave(up.up), {}
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if not m[0].endswith("/>"):
                at = end.end() if end else n
            continue
        noise, main = _roles(m[3]) if m[3] else (False, 0)
        if tag == "header" and (on_path.get("article") or on_path.get("main")):
            noise_tag = False  # the article's own heading; what it holds beside that is told by class
        else:
            noise_tag = tag in NOISE
        if tag in INLINE:
            if not noise:
                if tag not in VOID:
                    open_inline[tag] = open_inline.get(tag, 0) + 1
                continue
        elif tag in VOID:
            flush()
            continue
        flush()
        if tag in CLOSES_P:
            up = now
            while up.up is not None and up.tag in INLINE:
                up = up.up
            if up.tag == "p" or tag == "li" and up.tag == "li":
                now = leave(up.up)
            if tag not in INLINE:
                open_inline = {}
        node = Node(tag, now, noise or noise_tag, 3 if tag in ("article", "main") else main)
        now.kids.append(node)
        if not m[0].endswith("/>"):
            now = node
            on_path[tag] = on_path.get(tag, 0) + 1
    flush()
    return root


def match(a: Node, b: Node, pairs: list[tuple[Node, Node]] | None = None) -> int:
    """Simple tree matching: size of the largest order-preserving map between trees with equal roots; ``pairs`` collects it.

    Leaves are equal when both are text; that their texts differ is what makes a slot.  Children are aligned by the sizes of their own
    matchings, deepest first, without recursion, so trees may be of any depth.  In lists of more than MAX_CELLS pairs, sizes are made
    once for children that are alike (see ``_Alike``); lists of any length are aligned in the same way, with the same result.
    """
    if a.tag != b.tag:
        return 0
    sizes: dict[tuple[int, int], int] = {}
    _measure(a, b, sizes)
    if pairs is not None:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            pairs.append((x, y))
            if (id(x), id(y)) not in sizes and _inner(x, y):
                _measure(x, y, sizes)  # only two that are like them were measured
            todo += _aligned(x, y, sizes)
    return sizes[id(a), id(b)]


def _measure(a: Node, b: Node, sizes: dict[tuple[int, int], int]) -> None:
    """Sizes of the matching of two nodes and of all below that it needs."""
    stack: list[tuple[Node, Node, Callable | None]] = [(a, b, None)]
    while stack:
        x, y, weights = stack.pop()
        if (id(x), id(y)) in sizes:
            continue
        if weights is None:
            below, weights = _weights(x, y)
            below = [(u, v, None) for u, v in below if (id(u), id(v)) not in sizes and _inner(u, v)]
            if below:
                stack.append((x, y, weights))
                stack += below
                continue
        row, weight = np.zeros(len(y.kids) + 1, np.int64), weights(sizes)
        for i in range(len(x.kids)):
            row = _row(row, weight(i))
        sizes[id(x), id(y)] = 1 + int(row[-1])


def _long(a: Node, b: Node) -> bool:
    return len(a.kids) * len(b.kids) > MAX_CELLS


def _inner(a: Node, b: Node) -> bool:
    """Whether the weight of two children is the size of a matching of their own."""
    if a.tag != b.tag or a.tag == "#" or not a.kids or not b.kids:
        return False
    return not (len(a.kids) == 1 == len(b.kids) and a.kids[0].tag == "#" == b.kids[0].tag)


def _weight(a: Node, b: Node, sizes: dict[tuple[int, int], int]) -> int:
    """Matching of two children; equal texts count double, so that constant nodes find each other among slots."""
    if a.tag != b.tag:
        return 0
    if a.tag == "#":
        return 2 if a.text == b.text else 1
    if len(a.kids) == 1 == len(b.kids) and a.kids[0].tag == "#" == b.kids[0].tag:
        return 3 if a.kids[0].text == b.kids[0].text else 2
    return sizes.get((id(a), id(b)), 1) if a.kids and b.kids else 1


def _aligned(a: Node, b: Node, sizes: dict[tuple[int, int], int]) -> list[tuple[Node, Node]]:
    """Children that the best order-preserving alignment puts together."""
    m, n = len(a.kids), len(b.kids)
    if not m or not n:
        return []
    return [(a.kids[i], b.kids[j]) for i, j in _traced(m, n, _weights(a, b)[1](sizes))]


def _weights(a: Node, b: Node) -> tuple[list[tuple[Node, Node]], Callable]:
    """Pairs of children that tell all weights, and what makes of their sizes the weights of each child of ``a`` with those of ``b``."""
    if _long(a, b):
        alike = _Alike(a, b)
        return alike.pairs, alike.weights
    return [(x, y) for x in a.kids for y in b.kids], lambda sizes: np.array([[_weight(x, y, sizes) for y in b.kids] for x in a.kids]).__getitem__


def _row(before: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The next row of the table of best alignments."""
    row = np.zeros_like(before)
    row[1:] = np.maximum.accumulate(np.maximum(before[1:], before[:-1] + weight))
    return row


def _traced(m: int, n: int, weights: Callable[[int], np.ndarray]) -> list[tuple[int, int]]:
    """Places that the best alignment of two lists puts together, from the weights of each place of the first list.

    Of the table only every so many rows are kept; the rows between are made again on the way back.
    """
    step = max(int(m ** 0.5) + 1, 64)
    row = np.zeros(n + 1, np.int64)
    kept = {0: row}
    for i in range((m - 1) // step * step):
        row = _row(row, weights(i))
        if (i + 1) % step == 0:
            kept[i + 1] = row
    out, i, j, first = [], m, n, m
    best: dict[int, np.ndarray] = {}
    weight: dict[int, np.ndarray] = {}
    while i and j:
        if i <= first:
            first = (i - 1) // step * step
            best, weight = {first: kept[first]}, {}
            for k in range(first, i):
                weight[k] = weights(k)
                best[k + 1] = _row(best[k], weight[k])
        if weight[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + weight[i - 1][j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


class _Alike:
    """The children of two nodes by classes, so that the weight of two is made once for all that are like them.

    A weight depends on the elements of both and on which of their texts are equal.  So a child is known by its elements and
    those of its texts that the other list has too; two children that share no text are known by their elements alone.
    """

    def __init__(self, a: Node, b: Node):
        left, right = [_content_of(x) for x in a.kids], [_content_of(y) for y in b.kids]
        common = {t for _, texts in left for t in texts} & {t for _, texts in right for t in texts}
        shapes: dict[tuple, int] = {}
        self.left, rows = self._classes(left, common, shapes)
        self.right, columns = self._classes(right, common, shapes)
        heads = [a.kids[k] for k, _, _ in rows], [b.kids[k] for k, _, _ in columns]
        self.shape = np.array([s for _, s, _ in columns], np.int64)
        # for each shape its classes of the right and their texts as numbers, 0: a text of this list only
        number = {t: k for k, t in enumerate(sorted(common), 1)}
        shaped: dict[int, list[int]] = {}
        for j, (_, s, _) in enumerate(columns):
            shaped.setdefault(s, []).append(j)
        texts_of = {s: np.array([[number.get(t, 0) for t in columns[j][2]] for j in js], np.int64).reshape(len(js), -1) for s, js in shaped.items()}
        places = {s: np.array(js, np.int64) for s, js in shaped.items()}
        known: dict[tuple, int] = {}
        self.pairs: list[tuple[Node, Node]] = []  # two children for each weight
        self.of: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # for a class of the left: weights by shape, and the classes with weights of their own
        plain: dict[int, np.ndarray] = {}
        held = np.zeros(len(number) + 1, bool)
        for i, (_, mine, texts) in enumerate(rows):
            own = plain.setdefault(mine, np.full(len(shapes), -1, np.int64))
            mine_held = [number[t] for t in set(texts) - {None}]
            held[mine_held] = True
            sharing, names = [], []
            for s, at in places.items():
                shared = np.where(held[texts_of[s]], texts_of[s], 0)
                some = np.flatnonzero(shared.any(axis=1)) if mine_held else np.zeros(0, np.int64)
                if own[s] < 0 and len(some) < len(at):
                    alone = np.ones(len(at), bool)
                    alone[some] = False
                    own[s] = self._named(known, (mine, s), heads[0][i], heads[1][at[alone.argmax()]])
                if len(some):
                    cells = np.ascontiguousarray(shared[some]).view([("", np.int64)] * shared.shape[1]).ravel()
                    _, first, of = np.unique(cells, return_index=True, return_inverse=True)
                    named = [self._named(known, (mine, s, *_pattern(texts, columns[j][2])), heads[0][i], heads[1][j]) for j in at[some[first]].tolist()]
                    sharing.append(at[some])
                    names.append(np.array(named, np.int64)[of])
            held[mine_held] = False
            none = np.zeros(0, np.int64)
            self.of.append((own, np.concatenate([none, *sharing]), np.concatenate([none, *names])))

    @staticmethod
    def _classes(contents: list[tuple[tuple, list[str]]], common: set[str], shapes: dict[tuple, int]) -> tuple[np.ndarray, list[tuple[int, int, tuple]]]:
        """The class of each child, and of each class its first child, its shape and its texts that count."""
        made: dict[tuple, int] = {}
        classes, out = [], []
        for k, (elements, texts) in enumerate(contents):
            key = shapes.setdefault(elements, len(shapes)), tuple(t if t in common else None for t in texts)
            if key not in made:
                made[key] = len(out)
                out.append((k, *key))
            classes.append(made[key])
        return np.array(classes, np.int64), out

    def _named(self, known: dict[tuple, int], key: tuple, u: Node, v: Node) -> int:
        name = known.setdefault(key, len(self.pairs))
        if name == len(self.pairs):
            self.pairs.append((u, v))
        return name

    def weights(self, sizes: dict[tuple[int, int], int]) -> Callable[[int], np.ndarray]:
        """The weights of a child of the left with all of the right; the sizes of ``pairs`` are known."""
        worth = np.array([*(_weight(u, v, sizes) for u, v in self.pairs), 0], np.int64)

        def row(i: int) -> np.ndarray:
            plain, sharing, names = self.of[self.left[i]]
            out = worth[plain[self.shape]]
            out[sharing] = worth[names]
            return out[self.right]

        return row


def _content_of(node: Node) -> tuple[tuple, list[str]]:
    """The elements of a node and all below it, with their number of children, and the texts, in page order."""
    elements, texts, stack = [], [], [node]
    while stack:
        x = stack.pop()
        elements.append((x.tag, len(x.kids)))
        if x.tag == "#":
            texts.append(x.text)
        stack += reversed(x.kids)
    return tuple(elements), texts


def _pattern(left: tuple, right: tuple) -> tuple[tuple, tuple]:
    """Which texts of two children are equal, whatever they say."""
    both = set(left) & set(right) - {None}
    number: dict[str, int] = {}
    for t in left:
        if t in both:
            number.setdefault(t, len(number))
    return tuple(map(number.get, left)), tuple(map(number.get, right))


class Wrapper:
    """The tree of a host's first reference and which of its text nodes are constant."""

    def __init__(self, pages: list[str]):
        trees = [parse(p) for p in pages]
        self.tree = trees[0]
        same: dict[int, int] = {}
        others = 0
        for other in trees[1:]:
            pairs: list[tuple[Node, Node]] = []
            match(self.tree, other, pairs)
            equal = [x for x, y in pairs if x.tag == "#" and x.text == y.text]
            if 2 * _running(equal) > max(_running(_leaves(self.tree)), _running(_leaves(other)), 1):
                continue  # near copies, which share their running text, say nothing about the template
            others += 1
            for x in equal:
                same[id(x)] = same.get(id(x), 0) + 1
        # one page of another layout among the references does not undo the template
        self.constant = {k for k, v in same.items() if 2 * v > others}

    def template(self, page: Node) -> set[int]:
        """Text nodes of a page that lie on constant nodes and say the same."""
        if not self.constant:
            return set()
        pairs: list[tuple[Node, Node]] = []
        match(self.tree, page, pairs)
        return {id(y) for x, y in pairs if id(x) in self.constant and x.text == y.text}


def _leaves(node: Node) -> list[Node]:
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if x.tag == "#":
            out.append(x)
        stack += x.kids
    return out


def _running(leaves: list[Node]) -> int:
    """Characters of running text: of blocks that are longer than a line of a menu and not a link."""
    return sum(len(x.text) for x in leaves if len(x.text) >= LINE and x.linked * 2 < len(x.text) and not _in_noise(x))


def _in_noise(x: Node) -> bool:
    while x is not None:
        if x.noise:
            return True
        x = x.up
    return False


def _content(node: Node, template: set[int]) -> list[Node]:
    """Text leaves below a node that are neither noise nor template, in page order."""
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if x.tag == "#":
            if id(x) not in template:
                out.append(x)
        elif not x.noise or x is node:
            stack += reversed(x.kids)
    return out


def _article(root: Node, template: set[int]) -> list[Node]:
    """The content leaves of the page: of the elements that say they are the article, else of the densest part."""
    nodes, stack = [], [root]
    while stack:
        x = stack.pop()
        if x.tag != "#" and not x.noise:
            nodes.append(x)
            stack += reversed(x.kids)
    for named in (lambda x: x.tag == "article", lambda x: x.tag == "main" or x.main >= 2):
        tops = [x for x in nodes if named(x)]
        marked = {id(x) for x in tops}
        inner = [x for x in tops if not _below(x, marked)]
        leaves = [leaf for x in inner for leaf in _content(x, template)]
        if leaves:
            return leaves
    found = [x for x in _content(root, template) if x.linked * 2 < len(x.text) or x.up.tag == "p"]
    if template:
        return found  # the host's template is known: every slot that varies is content
    # the lowest element that holds all parts with much running text
    score: dict[int, int] = {}
    parts: dict[int, Node] = {}
    for leaf in found:
        block = leaf.up
        while block.up is not None and block.tag in ("p", "li", "ul", "ol", "blockquote", "span", "td", "tr", "tbody", "h1", "h2", "h3", "h4", "h5", "h6"):
            block = block.up
        worth = len(leaf.text) if len(leaf.text) >= LINE or "." in leaf.text else len(leaf.text) // 4
        score[id(block)] = score.get(id(block), 0) + worth * (13 if block.main else 10)
        parts[id(block)] = block
    if not score:
        return found
    dense = [parts[k] for k, v in score.items() if 10 * v >= max(score.values())]
    cover = _common(dense)
    return [x for x in found if _within(x, cover)]


def _below(x: Node, marked: set[int]) -> bool:
    x = x.up
    while x is not None:
        if id(x) in marked:
            return True
        x = x.up
    return False


def _within(x: Node, top: Node) -> bool:
    while x is not None:
        if x is top:
            return True
        x = x.up
    return False


def _common(nodes: list[Node]) -> Node:
    """The lowest node that holds all ``nodes``."""
    path, x = [], nodes[0]
    while x is not None:
        path.append(x)
        x = x.up
    place = {id(x): k for k, x in enumerate(path)}
    top = 0
    for x in nodes[1:]:
        while id(x) not in place:
            x = x.up
        top = max(top, place[id(x)])
    return path[top]


def main_text(page: str | None, wrapper: Wrapper | None = None) -> str:
    if not page:
        return ""
    tree = parse(page)
    leaves = _article(tree, wrapper.template(tree) if wrapper else set())
    return "\n".join(x.text for x in leaves)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", refs: int = REFS, part_pages: int = PART_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    Pages are shuffled once, compressed.  A host's references are its first pages in the order of their hash, so they come
    with the host.  Only a host of more than ``part_pages`` pages, and of more than a MAX_LARGE-th of all, is dealt over
    parts; its references are chosen beforehand and sent to each part.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    mark = F.when(F.length(html) > 0, F.xxhash64(F.col(html)))
    rows = pages.select(host.alias("host"), mark.alias("h"), F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    kind = dict(rows.dtypes)["page_id"]
    names = ["host", "part", "kind", "h", "page_id", "url", "packed"]
    large = _large_hosts(rows.select("host", "h"), refs, part_pages)
    own = _packed(rows)
    if large is None:
        both = own.select("host", F.lit(0).alias("part"), F.lit(1).alias("kind"), "h", "page_id", "url", "packed")
    else:
        dealt = own.join(F.broadcast(large), "host", "left")  # at most MAX_LARGE rows
        both = dealt.select("host", F.coalesce(F.pmod(F.xxhash64("h", "page_id"), F.col("parts")).cast("int"), F.lit(0)).alias("part"), F.lit(1).alias("kind"),
                            "h", "page_id", "url", "packed")
        given = dealt.where(F.array_contains("refs", F.col("h"))).groupBy("host", "h").agg(F.first("packed").alias("packed"), F.first("parts").alias("parts"))
        both = both.unionByName(given.select(
            "host", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "h", F.lit(None).cast(kind).alias("page_id"),
            F.lit(None).cast("string").alias("url"), "packed"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, given_, waiting, wrapper, out = None, {}, [], None, []
        for batch in batches:
            for host_, part, kind_, h, i, u, z in zip(*(c.to_pylist() for c in batch.columns)):
                if (host_, part) != now:
                    out += _read(waiting, given_, wrapper)
                    now, given_, waiting, wrapper = (host_, part), {}, [], None
                page = None if z is None else zlib.decompress(z).decode()
                if h is not None and len(given_) < refs:
                    given_.setdefault(h, page)
                if kind_:
                    waiting.append((i, u, page))
                if wrapper is None and len(given_) == refs:
                    wrapper = Wrapper(list(given_.values()))
                if wrapper is not None:
                    out += _read(waiting, given_, wrapper)
                    waiting = []
            if len(out) >= 500:
                yield record(out)
                out = []
        out += _read(waiting, given_, wrapper)
        if out:
            yield record(out)

    def record(out: list[tuple]) -> pa.RecordBatch:
        ids, urls, texts = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(ids, id_kind), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                          ["page_id", "url", "text", "n_chars"])

    id_kind = to_arrow_type(rows.schema["page_id"].dataType)
    return both.select(*names).repartition("host", "part").sortWithinPartitions("host", "part", "kind", "h").mapInArrow(
        run, f"page_id {kind}, url string, text string, n_chars long")


def _read(waiting: list[tuple], given: dict, wrapper: Wrapper | None) -> list[tuple]:
    """Texts of the pages that waited for the host's references."""
    if wrapper is None and len(given) > 1 and waiting:
        wrapper = Wrapper(list(given.values()))
    return [(i, u, main_text(page, wrapper)) for i, u, page in waiting]


def _packed(rows: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [None if t is None else zlib.compress(t.encode(), 3) for t in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(packed, pa.binary())], ["host", "h", "page_id", "url", "packed"])

    return rows.mapInArrow(run, f"host string, h long, page_id {dict(rows.dtypes)['page_id']}, url string, packed binary")


def _large_hosts(rows: DataFrame, refs: int, part_pages: int) -> DataFrame | None:
    """(host, parts, refs) of the hosts that are dealt over parts; None if there are none."""
    sizes = written(rows.groupBy("host").count(), "hosts")
    limit = max(part_pages, (sizes.agg(F.sum("count")).first()[0] or 0) // MAX_LARGE)
    large = sizes.where(F.col("count") > limit)
    if large.isEmpty():
        return None
    # the ``refs`` least hashes of a host are no greater than the ``refs`` least of those that are least in one of 64 classes
    known = rows.where("h IS NOT NULL").join(F.broadcast(large.select("host")), "host")
    least = known.groupBy("host", F.pmod("h", F.lit(64)).alias("d")).agg(F.min("h").alias("h"))
    bounds = least.groupBy("host").agg(F.sort_array(F.collect_list("h")).alias("l")).select(
        "host", F.when(F.size("l") >= refs, F.element_at("l", refs)).alias("bound"))  # null: few distinct pages
    near = known.join(F.broadcast(bounds), "host").where("bound IS NULL OR h <= bound")
    picks = near.groupBy("host").agg(F.slice(F.sort_array(F.collect_set("h")), 1, refs).alias("refs"))
    parts = F.ceil(F.col("count") / part_pages).cast("int")
    return written(large.select("host", parts.alias("parts")).join(picks, "host", "left"), "large-hosts")

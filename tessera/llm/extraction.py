"""HTML main-text extraction by inferring a union-free regular expression, the wrapper, for the pages of each host.

A page is read into a tree of tags. A wrapper is such a tree in which a node can be optional or repeated, a sequence of nodes can be
repeated as a group, and a text is either fixed or a slot; there are no alternatives. Two trees are aligned level by level:
sequences that one side repeats are grouped on the other, nodes that match are merged, a node that only one side has becomes optional,
adjacent equal nodes or sequences fold into one that is repeated, and texts that differ become a slot. Merging goes over all pages of a host.

To extract, a page's own expression is aligned with its host's wrapper in the same way, and each of its elements takes the part that
the wrapper's node has: template (a fixed text on ``TEMPLATE_PAGES`` different pages or more, and on half of the host's different pages
or more, while other texts vary), left out, or a slot. What aligns with nothing is a slot. The main region is the topmost article or main
element; a host without them has the narrowest element outside of which all text is template or left out, and lists of links there
are menus if they are template, or if their links are of ``MENU_WORDS`` words or fewer on average. Headings of the main region are never template. A page that lacks its host's region goes by its own expression.

Outside of article and main elements, menus, headers, footers, sidebars, notices, adverts, forms and comments go by their tag or by words of their class, id or role. Inside of them
headers and menu elements stay, and a class, id or role counts only if all its words are such words, or the first is one for comments; headings stay whatever their class. Such words
never leave out html or body, nor do they or a form leave out an element that holds the page's only article, or, other than those for comments, one that holds half of the page's
text or more where no article is elsewhere. Text of the rest is decoded, blocks are trimmed with white space made one space, and
joined by a line feed. Line breaks (br) are white space. Drawings (svg) and what shows only without scripts have no text.

Scale: tasks merge the pages that they read into one wrapper a host, so that a host of any size sends one small tree from each
task; those are merged by host. A node counts its different pages by the ``SKETCH`` least hashes of their markup. Pages are then joined with
their host's wrapper, those of very common hosts without a shuffle, and are read a second time. No host's pages meet in one
task. The wrappers of hosts that have a large share of all pages go to each task once, if they are of ``SHARED_BYTES`` together at most, and not with each page. Of the children of a node, those of one tag that are on under a quarter of its pages each are one node, without their classes, once there are over ``KINDS``; so a wrapper is
bounded by what a page holds, however many classes its host has.

Nulls: null html is empty; a page without markup is its text. Null urls, and urls without a host, share the empty host.
Repeated rows are pages of their own, but pages that are all equal make no template. Of alignments that are as long, the one that takes the wrapper's node first is taken. A page is held as a whole, with its tree. An empty table gives an empty table.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import Scratch, attached, parts

#: Different pages of a host that must share a text before it is template; least hashes that a node keeps to count its pages.
TEMPLATE_PAGES, SKETCH = 3, 8
#: Rare children of one tag that a wrapper tells apart by their classes; words of a menu's link, on average.
KINDS, MENU_WORDS = 8, 3
#: Of the wrappers that each task gets as a whole, together.
SHARED_BYTES = 64 << 20
#: Elements nested deeper than this are read as breaks between blocks in the one that holds them: the text is the same.
DEEPEST = 200

# HTML elements by role, and words that mark what isn't the article.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noscript script style svg template textarea title".split())
LEFT_OUT = frozenset("aside button dialog footer form head header input menu nav option select".split())
ENDS_PARAGRAPH = BLOCKS
SELF_CLOSING = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
MARKS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu breadcrumb breadcrumbs sidebar widget widgets related recommended share sharing social comment comments disqus respond reply replies footer header masthead topbar toolbar pagination pager search complementary contentinfo".split())
#: Marks that stand however much text they hold; words that begin a class which says something of the whole page, not what it is.
COMMENTS = frozenset("comment comments disqus respond reply replies".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 caption dt legend summary th".split())
STAYS_INSIDE, LISTS = frozenset("header menu".split()), frozenset("menu ol ul".split())
STATES = frozenset("has with without no not is js".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")


class Node:
    """An element. ``out``: left out; ``marked``: only by words or as a form, which ``settle`` may overrule; ``inside``: of an article or main element, or one itself."""

    __slots__ = ("tag", "sig", "out", "marked", "comments", "main", "inside", "children")

    def __init__(self, tag: str, attributes: str = "", inside: bool = False):
        self.tag, self.children, self.out, self.main, self.sig, self.marked, self.comments = tag, [], tag in LEFT_OUT and not (inside and tag in STAYS_INSIDE), tag in ("article", "main"), tag, tag == "form", False
        if attributes:
            found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
            self.main |= found.get("role") == "main" or found.get("itemprop") == "articleBody"
            if (not self.out or self.marked) and tag not in ("html", "body"):
                words: set[str] = set()
                for k in ("class", "id", "role"):
                    for token in found.get(k, "").split():
                        parts = [w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower()) if w]
                        if parts and parts[0] not in STATES and (not inside or tag not in HEADINGS and (parts[0] in COMMENTS or MARKS.issuperset(parts))):
                            words.update(parts)
                self.marked, self.comments = self.marked or not MARKS.isdisjoint(words), not COMMENTS.isdisjoint(words)
                hidden = found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower() or re.search(r"\shidden(\s|$|=)", attributes) is not None
                self.out = self.marked or hidden
                self.marked &= not hidden
            if found.get("class"):
                self.sig += "." + ".".join(sorted(re.sub(r"\d+", "0", found["class"]).split()))
        self.inside = inside or self.main


def parse(page: str) -> Node:
    """A lenient tree: unclosed elements end with what holds them, stray ends are left out."""
    root = Node("#root")
    stack, at, end = [root], 0, len(page)
    deeper: Counter[str] = Counter()  # open elements that are too deep for the stack

    def close(names: tuple[str, ...] | str, walls: tuple[str, ...] = ()) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                del stack[i:]
                deeper.clear()
                return
            if stack[i].tag in walls:
                return

    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        if m[4] is not None:
            stack[-1].children.append(html.unescape(m[4]))
        elif m[2]:
            tag = m[2].lower()
            if m[1] and deeper[tag]:
                deeper[tag] -= 1
                if tag in BLOCKS:
                    stack[-1].children.append(Node("#break"))
                continue
            if m[1]:
                close((tag,), () if tag in ("article", "main", "body", "html") else ("article", "main", "body") if tag not in BLOCKS else ())
                continue
            if tag in ENDS_PARAGRAPH:
                close(("p",), ("article", "main", "section", "div", "td", "th", "li", "blockquote", "body", "aside", "nav", "footer", "header", "form"))
            if tag in SELF_CLOSING:
                close((tag, "dd", "dt") if tag in ("dd", "dt") else (tag, "td", "th") if tag in ("td", "th") else (tag,), SELF_CLOSING[tag])
            empty = m[3].rstrip().endswith("/")
            if tag in RAW:
                if not (empty and tag == "svg"):
                    stop = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>", re.I).search(page, at)
                    at = stop.end() if stop else end
                continue
            node = Node(tag, m[3], stack[-1].inside)
            if len(stack) < DEEPEST or node.out and len(stack) == DEEPEST:
                stack[-1].children.append(node)
                if tag not in VOID and not empty:
                    stack.append(node)
            elif tag in VOID or empty:
                stack[-1].children.append(node)
            else:
                deeper[tag] += 1
                if tag in BLOCKS:
                    stack[-1].children.append(Node("#break"))
    settle(root)
    return root


def settle(root: Node) -> None:
    """Takes back the marks by words that can't be right (see above)."""
    size: dict[int, int] = {}
    mains: dict[int, int] = {}

    def measure(n: Node) -> None:
        chars, main = 0, int(n.main)
        for c in n.children:
            if isinstance(c, str):
                chars += len(c.strip())
            else:
                measure(c)
                if not c.out or c.marked:
                    chars += size[id(c)]
                    main += 0 if c.comments else mains[id(c)]
        size[id(n)], mains[id(n)] = chars, main

    def free(n: Node, inside: bool) -> int:
        """Articles outside of what is left out."""
        found = int(n.main and not inside)
        for c in n.children:
            if not isinstance(c, str):
                found += free(c, inside or c.out)
        return found

    def undo(n: Node, all_marks: bool) -> None:
        for c in n.children:
            if not isinstance(c, str):
                holder = not alone and not c.comments and (mains[id(c)] == mains[id(root)] > 0 or not mains[id(root)] and 2 * size[id(c)] >= size[id(root)] > 0)
                if c.marked and (all_marks or holder):
                    c.out = c.marked = False
                if not c.out or c.marked:
                    undo(c, all_marks)

    def left(n: Node) -> bool:
        for c in n.children:
            if c.strip() if isinstance(c, str) else not c.out and left(c):
                return True
        return False

    def demote(n: Node, out: bool) -> None:
        n.main &= not out
        for c in n.children:
            if not isinstance(c, str):
                demote(c, out or c.out)

    measure(root)
    alone = free(root, False)
    undo(root, False)
    if not left(root):
        undo(root, True)
    demote(root, False)


def blocks_of(node: Node) -> list[Node]:
    """The blocks directly below, through what isn't one."""
    out: list[Node] = []
    for c in node.children:
        if not isinstance(c, str):
            if c.tag in BLOCKS or c.out:
                out.append(c)
            elif c.tag != "#break":
                out += blocks_of(c)
    return out


def _text(node: Node) -> str:
    out: list[str] = []

    def inner(n: Node) -> None:
        for c in n.children:
            if isinstance(c, str):
                out.append(c)
            elif c.tag in ("br", "#break"):
                out.append(" ")
            elif c.tag not in BLOCKS and not c.out:
                inner(c)

    inner(node)
    return " ".join("".join(out).split())


# A wrapper: [sig, least hashes of its pages, optional, repeated, text (0: none, a number: that of the fixed text, -1: a slot), characters, children, is left out,
# is a main region, elements of the page at hand]. A group that is repeated is a node whose sig is those of its sequence in brackets.
SIG, PAGES, OPTIONAL, REPEATED, TEXT, CHARS, CHILDREN, OUT, MAIN, REFS = range(10)


def skeleton(root: Node, page: str) -> list:
    pages = [zlib.crc32(page.encode("utf-8", "replace"))]

    def of(node: Node) -> list:
        own = _text(node)
        text = own or ("\n".join(_links(node)) if node.tag in LISTS and not node.inside and _is_menu(node) else "")
        children = [of(c) for c in blocks_of(node)] if not node.out else []
        return [node.sig, pages, False, False, zlib.crc32(text.encode("utf-8", "replace")) + 1 if text else 0, len(own), fold(children), node.out, node.main, [node]]

    return of(root)


def merged(a: list, b: list, pages: bool) -> list:
    """``pages``: the two are of different pages, and not repetitions on one."""
    text = a[TEXT] if a[TEXT] == b[TEXT] else -1
    seen = a[PAGES] if a[PAGES] == b[PAGES] else sorted({*a[PAGES], *b[PAGES]})[:SKETCH]
    return [a[SIG], seen, a[OPTIONAL] or b[OPTIONAL], a[REPEATED] or b[REPEATED] or not pages, text, a[CHARS] + b[CHARS], compact(align(a[CHILDREN], b[CHILDREN], pages), seen), a[OUT] and b[OUT], a[MAIN] or b[MAIN], a[REFS] + b[REFS]]


def compact(nodes: list, pages: list[int]) -> list:
    """Children of a node on ``pages``: of each tag the rare ones are one node once they are over ``KINDS``."""
    if len(nodes) <= KINDS:
        return nodes
    total = distinct(pages)
    rare: dict[tuple, list[int]] = {}
    for i, n in enumerate(nodes):
        if n[SIG][0] != "(" and (n[SIG][-1] == "*" or n[OPTIONAL] and 4 * distinct(n[PAGES]) < total):
            rare.setdefault((n[SIG].split(".")[0].rstrip("*"), n[OUT], n[MAIN]), []).append(i)
    gone: set[int] = set()
    out = list(nodes)
    for (tag, _, _), places in rare.items():
        if len(places) > KINDS or len(places) > 1 and any(nodes[i][SIG][-1] == "*" for i in places):
            one = [f"{tag}*", *nodes[places[0]][PAGES:]]
            for i in places[1:]:
                one = merged(one, nodes[i], True)
            out[places[0]] = [one[SIG], one[PAGES], True, True, *one[TEXT:]]
            gone.update(places[1:])
    return fold([n for i, n in enumerate(out) if i not in gone]) if gone else nodes


def group(nodes: list) -> list:
    """A repeated group of a sequence of nodes."""
    first = nodes[0]
    return [f"({' '.join(n[SIG] for n in nodes)})", first[PAGES], False, True, 0, 0, nodes, False, False, []]


def grouped(nodes: list, like: list) -> list:
    """``nodes`` with the sequences grouped that are groups in ``like``."""
    for g in like:
        if g[SIG][0] == "(" and len(nodes) > 1:
            sigs = [n[SIG] for n in g[CHILDREN]]
            out, i = [], 0
            while i < len(nodes):
                if nodes[i][SIG] == sigs[0] and [n[SIG] for n in nodes[i : i + len(sigs)]] == sigs:
                    out.append(group(nodes[i : i + len(sigs)]))
                    i += len(sigs)
                else:
                    out.append(nodes[i])
                    i += 1
            nodes = out
    return nodes


def paired(a: list, b: list) -> list[tuple[list | None, list | None]]:
    """The longest common sequence of the two in pairs; the others alone, in order."""
    a, b = grouped(a, b), grouped(b, a)
    common = {n[SIG]: n for n in a if n[SIG][-1] == "*"}
    if common:  # a node that no class of the wrapper has is one of its tag's
        known = {n[SIG] for n in a}
        b = [n if n[SIG] in known or f"{n[SIG].split('.')[0]}*" not in common else [f"{n[SIG].split('.')[0]}*", *n[PAGES:]] for n in b]
    start = 0
    while start < min(len(a), len(b)) and a[start][SIG] == b[start][SIG]:
        start += 1
    out: list = [*zip(a[:start], b[:start], strict=True)]
    a, b = a[start:], b[start:]
    length = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            length[i][j] = length[i + 1][j + 1] + 1 if a[i][SIG] == b[j][SIG] else max(length[i + 1][j], length[i][j + 1])
    i = j = 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i][SIG] == b[j][SIG]:
            out.append((a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and length[i + 1][j] >= length[i][j + 1]:
            out.append((a[i], None))
            i += 1
        else:
            out.append((None, b[j]))
            j += 1
    return out


def align(a: list, b: list, pages: bool) -> list:
    """What is paired is merged; the others become optional."""
    return fold([merged(x, y, pages) if x and y else [*(x or y)[:OPTIONAL], True, *(x or y)[REPEATED:]] for x, y in paired(a, b)])


def fold(nodes: list) -> list:
    """Adjacent equal nodes become one that is repeated, then adjacent equal sequences of up to 6 nodes a group."""
    for size in range(1, 7):
        if len(nodes) < 2 * size:
            break
        out: list = []
        for n in nodes:
            out.append(n)
            if size > 1 and len(out) > size and out[-size - 1][SIG][0] == "(" and [x[SIG] for x in out[-size:]] == [x[SIG] for x in out[-size - 1][CHILDREN]]:
                last = out[-size:]
                del out[-size:]
                out[-1] = merged(out[-1], group(last), False)
            elif len(out) >= 2 * size and [x[SIG] for x in out[-size:]] == [x[SIG] for x in out[-2 * size : -size]]:
                last, before = out[-size:], out[-2 * size : -size]
                del out[-2 * size :]
                out.append(merged(before[0], last[0], False) if size == 1 else merged(group(before), group(last), False))
        nodes = out
    return nodes


def plain(n: list) -> list:
    """A wrapper without the elements of a page."""
    return [*n[:CHILDREN], [plain(c) for c in n[CHILDREN]], *n[OUT:REFS], []]


def distinct(pages: list[int]) -> float:
    """Different pages, by the least of their hashes; exact below ``SKETCH``."""
    return float(len(pages)) if len(pages) < SKETCH else (SKETCH - 1) * 2.0**32 / max(pages[-1], 1)


class Wrapper:
    """What extraction asks of a wrapper: its main regions, and which texts are template. Nodes are told by ``id``."""

    def __init__(self, root: list):
        self.root = root
        self.fixed: set[int] = set()
        half = distinct(root[PAGES]) / 2
        top: list[list] = []

        def walk(n: list, within: bool) -> None:
            if n[TEXT] > 0 and distinct(n[PAGES]) >= max(TEMPLATE_PAGES, half):
                self.fixed.add(id(n))
            if n[MAIN] and not within:
                top.append(n)
            for c in n[CHILDREN]:
                walk(c, within or n[MAIN])

        walk(root, False)
        self.by_mark = bool(top)
        self.main = {id(n) for n in top} or {id(self.narrow())}

        def keep_headings(n: list, inside: bool) -> None:
            inside |= id(n) in self.main
            if inside and n[SIG].split(".")[0] in HEADINGS:
                self.fixed.discard(id(n))
            for c in n[CHILDREN]:
                keep_headings(c, inside)

        keep_headings(root, False)
        self.varies = False

        def vary(n: list, inside: bool) -> None:
            inside |= id(n) in self.main
            self.varies |= inside and n[TEXT] == -1 and not n[OUT]
            for c in n[CHILDREN]:
                vary(c, inside)

        vary(root, False)
        if not self.varies:
            self.fixed = set()

    def holds(self, n: list) -> bool:
        """Has text that is neither template nor left out."""
        if n[OUT]:
            return False
        if n[CHARS] and id(n) not in self.fixed:
            return True
        for c in n[CHILDREN]:
            if self.holds(c):
                return True
        return False

    def narrow(self) -> list:
        at = self.root
        while True:
            own = at[CHARS] and id(at) not in self.fixed
            below = [c for c in at[CHILDREN] if self.holds(c)]
            if own or len(below) != 1 or below[0][REPEATED] or not below[0][CHILDREN]:
                return at
            at = below[0]


def matched(wrapper: list, own: list) -> dict[int, list]:
    """The wrapper's node for each element of the page, by ``id``; both trees are aligned from the top."""
    out: dict[int, list] = {}

    def walk(w: list, n: list) -> None:
        for element in n[REFS]:
            out[id(element)] = w
        for x, y in paired(w[CHILDREN], n[CHILDREN]):
            if x and y:
                walk(x, y)

    walk(wrapper, own)
    return out


def _links(node: Node) -> list[str]:
    """The texts of all links of an element."""
    out: list[str] = []

    def walk(n: Node, at: list[str] | None) -> None:
        for c in n.children:
            if isinstance(c, str):
                if at is not None:
                    at.append(c)
            elif c.tag == "a" and at is None:
                walk(c, one := [])
                out.append(" ".join("".join(one).split()))
            else:
                walk(c, at)

    walk(node, None)
    return out


def _is_menu(node: Node) -> bool:
    """All text or nearly all is of links, of which there are three or more."""
    chars = 0

    def walk(n: Node) -> None:
        nonlocal chars
        for c in n.children:
            if isinstance(c, str):
                chars += len(c.strip())
            else:
                walk(c)

    walk(node)
    links = _links(node)
    return len(links) >= 3 and sum(map(len, links)) >= 0.8 * chars > 0


def _short_links(node: Node) -> bool:
    links = [x for x in _links(node) if x]
    return sum(len(x.split()) for x in links) <= MENU_WORDS * len(links)


def extract(page: str, wrapper: Wrapper | None) -> str:
    """The main text. ``wrapper``: that of the page's host; none: the page's own expression."""
    root = parse(page)
    own = skeleton(root, page)
    w = wrapper or Wrapper(own)
    part = matched(w.root, own)
    if wrapper and not any(id(n) in w.main for n in part.values()):
        return extract(page, None)
    blocks: list[str] = []

    def emit(node: Node, inside: bool) -> None:
        buffer: list[str] = []
        keep = inside and id(part.get(id(node))) not in w.fixed

        def flush() -> None:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text and keep:
                blocks.append(text)

        def inner(n: Node) -> None:
            for c in n.children:
                if isinstance(c, str):
                    buffer.append(c)
                elif c.tag == "br":
                    buffer.append(" ")
                elif c.tag == "#break":
                    flush()
                elif c.tag in BLOCKS or c.out:
                    flush()
                    at = id(part.get(id(c)))
                    starts = at in w.main
                    if not c.out and (starts or w.by_mark or not _is_menu(c) or not (at in w.fixed or _short_links(c))):
                        emit(c, inside or starts)
                else:
                    inner(c)

        inner(node)
        flush()

    emit(root, id(w.root) in w.main)
    return "\n".join(blocks)


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper: JSON, n: pages) from ``pages`` (host, html)."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(known), pa.string()), pa.array([json.dumps(w) for w in known.values()], pa.string()), pa.array([counts[h] for h in known], pa.int64())], names=["host", "wrapper", "n"])
            known.clear()
            counts.clear()
            return out

        for b in batches:
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = plain(skeleton(parse(page), page))
                counts[host] += 1
                known[host] = merged(known[host], own, True) if host in known else own
                if len(known) >= 20_000:
                    yield flush()
        yield flush()

    def reduce(group: pd.DataFrame) -> pd.DataFrame:
        out = None
        for w in sorted(group["wrapper"]):
            out = merged(out, json.loads(w), True) if out else json.loads(w)
        return pd.DataFrame({"host": group["host"].iloc[:1], "wrapper": [json.dumps(out)], "n": [group["n"].sum()]})

    schema = "host string, wrapper string, n long"
    return pages.mapInArrow(gather, schema).groupBy("host").applyInPandas(reduce, schema)


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row for each row: page_id, url, text, n_chars."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    spark = pages.sparkSession
    of = Scratch(spark, "wrappers").write(wrappers(rows.select("host", "html")))
    total = of.agg(F.sum("n")).first()[0] or 0
    most = 4 * parts(spark)
    # fewer than ``most`` hosts have more than one in ``most`` of all pages: their wrappers go to each task once, if they are few bytes, and with each row else
    hot = of.where(F.col("n") * most > total)
    few = (hot.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0) <= SHARED_BYTES
    known = {r["host"]: r["wrapper"] for r in hot.select("host", "wrapper").collect()} if few else {}
    shared = spark.sparkContext.broadcast(known)
    schema = f"page_id {dict(rows.dtypes)['page_id']}, url string, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, Wrapper | None] = (None, None)
        for b in batches:
            texts: list[str] = [""] * b.num_rows
            hosts, htmls, own = b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4)
            for i in sorted(range(b.num_rows), key=lambda i: hosts[i]):  # each wrapper is read once a batch
                if hosts[i] != last[0]:
                    last = (hosts[i], Wrapper(json.loads(shared.value.get(hosts[i]) or own[i].as_py())))
                texts[i] = extract(htmls[i], last[1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    if not few:
        return attached(rows, of, "host", total).select("page_id", "url", "host", "html", "wrapper").mapInArrow(run, schema)
    names = F.broadcast(hot.select(F.col("host").alias("_hot")))  # under ``most`` rows
    there = rows.join(names, F.col("host") == F.col("_hot"), "left_semi").select("page_id", "url", "host", "html", F.lit(None).cast("string").alias("wrapper"))
    rest = rows.join(names, F.col("host") == F.col("_hot"), "left_anti").join(of.where(F.col("n") * most <= total).select("host", "wrapper"), "host")
    return there.unionByName(rest.select("page_id", "url", "host", "html", "wrapper")).mapInArrow(run, schema)

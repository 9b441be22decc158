"""Main text of web pages by composite text density.

A page is read into a tree by a tolerant tokenizer: end tags may be missing, attributes may hold ``>``, raw text ends
at its own end tag, and a page may be cut off anywhere. Elements that hold no article by their kind (scripts, forms, menus,
...) never get text, nor do blocks with such a whole class, id or role (footers, adverts, comments, ...), unless one whose name
may mean something else (as widget or search) holds most of the body's text. For every node the composite density is computed,

    C/T * log(C/LC * T/LT) / log(ln(C/nonLC * LC + LCb/Cb * C + e))

with C characters, T tags, LC and LT those inside links, and Cb, LCb those of the body. The densities of a node's
children are summed, and the subtree with the greatest sum is the article; where it lies in an ``article`` or ``main``
element, that element is. The least density on the path from there to the body is the threshold: a child below it whose
text is mostly links is left out. Where there is no such element, the densest node of every other subtree that reaches the
threshold is of the article too, and so are the blocks of running text beside them.

Blocks are trimmed, white space inside a block is one space, character references are decoded, and blocks are joined in
page order by two line feeds.

Cases: a null, empty or text-free page has the empty text; plain text without markup is its own article; repeated rows
are extracted row by row; null keys pass through; an empty table gives an empty result; very long or deep pages are taken
whole, in time in proportion; columns that are not asked for are not read, so they may have any name.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import arrow_map, table

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<([a-zA-Z][^\s/>]*)((?:[^'">]|"[^"]*"|'[^']*')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)>|</([a-zA-Z][^\s/>]*)[^>]*>|<[!?/][^>]*>|<[!?/a-zA-Z][^>]*\Z""", re.DOTALL)
ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"'>]|\Z)""", re.IGNORECASE)
NAME_PART = re.compile(r"[a-z]+")
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)

RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold article text.
DROPPED = frozenset("head script style textarea title xmp iframe noembed noframes noscript template svg math canvas object audio video nav aside footer form button select option label fieldset input dialog menu map".split())
#: The same by a class, id or role: one of these words, or several with or without ``PLAIN_NAMES``.
DROPPED_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice notices alert share sharing social related recommended newsletter subscribe subscription popup modal pagination pager login signup search contentinfo complementary widget".split())
#: Dropped unless inside an article: a page's header, not an article's.
HEADER_NAMES = frozenset("header masthead topbar".split())
#: Of these, those that never hold the article, even where they hold most of the text.
SURE_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored comment comments commentlist disqus reply replies respond cookie cookies consent gdpr nav navbar navigation breadcrumb breadcrumbs sidebar footer share sharing newsletter subscribe subscription popup modal pagination pager login signup contentinfo".split())
PLAIN_NAMES = frozenset("area bar block bottom box container content inner items left links list main outer page panel right section site sub top wrap wrapper".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCKS - frozenset("td th tr tbody thead tfoot body html caption".split())
#: What stands between the sections of an article and belongs to it.
RUNNING = frozenset("h1 h2 h3 h4 h5 h6 p ul ol dl pre blockquote figure table b i em strong span".split())
#: A start tag ends an open element of these, unless one of the second set is between.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
BARRIER = frozenset("article aside body button div dl fieldset footer form header html li main nav object ol section table td th ul".split())


class Node:
    __slots__ = ("tag", "parent", "children", "start", "stop", "chars", "tags", "link_chars", "link_tags", "density", "within", "named", "lost")

    def __init__(self, tag: str, parent: Node | None, start: int):
        self.tag, self.parent, self.start, self.stop = tag, parent, start, start
        self.children: list[Node] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = 0.0
        self.named = ""
        self.lost = (0, 0, 0, 0)
        self.within = tag in ("article", "main") or parent is not None and parent.within
        if parent is not None:
            parent.children.append(self)

    def lose(self, *counts: int) -> None:
        """Counts of what is taken out below."""
        self.lost = tuple(x + y for x, y in zip(self.lost, counts, strict=True))


def unwanted(tag: str, attributes: str, within: bool, top: bool) -> bool:
    """top: the element stands in the body itself, where a header is the page's."""
    if tag in DROPPED or tag == "header" and top:
        return True
    if attributes and tag not in ("html", "body", "article", "main"):
        for name, *values in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values).lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN_STYLE.search(value):
                return True
    return False


def named(tag: str, attributes: str, within: bool) -> str:
    """The name by which a block is likely no article, if any; headings and inline text are not judged by name."""
    if not attributes or tag not in BLOCKS or tag in HEADINGS or tag in ("body", "article", "main"):
        return ""
    for name, *values in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name not in ("class", "id", "role") or name == "id" and tag == "section" and within:  # the last is a heading's slug
            continue
        for token in "".join(values).lower().split():
            parts = set(NAME_PART.findall(token))
            telling = parts - PLAIN_NAMES
            if telling and (telling <= DROPPED_NAMES or not within and telling <= DROPPED_NAMES | HEADER_NAMES):
                return token
    return ""


class Tree:
    """The nodes of a page, and its text pieces in order; a None piece is the edge of a block."""

    def __init__(self, page: str):
        self.pieces: list[str | None] = []
        self.root = Node("html", None, 0)
        self.body = self.root
        self._open = [self.root]
        self._tags = Counter()  # of open elements but the root
        self._read(page)
        while self._open:
            self._pop()
        self._prune()

    def _prune(self) -> None:
        """Named elements go, unless they hold most of the body's text by a name that is not sure: there the densities decide.

        Where the page has an article or main element with text, it has to be around the named one or inside it.
        """
        whole, todo, holders, told = self.body.chars, [self.root], set(), False
        while todo:
            n = todo.pop()
            todo += n.children
            if n.tag in ("article", "main") and n.chars:
                told, up = True, n
                while up is not None:
                    holders.add(id(up))
                    up = up.parent

        def stays(c: Node) -> bool:
            free = not told or c.within or id(c) in holders
            return free and 2 * c.chars > whole and SURE_NAMES.isdisjoint(NAME_PART.findall(c.named))

        order, todo = [], [self.root]
        while todo:
            n = todo.pop()
            order.append(n)
            gone = [c for c in n.children if c.named and not stays(c)]
            for c in gone:
                self.pieces[c.start : c.stop] = [None] * (c.stop - c.start)
                n.lose(c.chars, c.tags + 1, c.link_chars, c.link_tags)
            if gone:
                out = set(map(id, gone))
                n.children = [c for c in n.children if id(c) not in out]
            todo += n.children
        for n in reversed(order):  # children before their parents
            if any(n.lost):
                n.chars, n.tags, n.link_chars, n.link_tags = (x - y for x, y in zip((n.chars, n.tags, n.link_chars, n.link_tags), n.lost, strict=True))
                if n.parent is not None:
                    n.parent.lose(*n.lost)

    def _pop(self) -> None:
        node = self._open.pop()
        self._tags[node.tag] -= 1
        if node.tag in BLOCKS:
            self.pieces.append(None)
        node.stop = len(self.pieces)
        link = node.tag == "a"
        if link:
            node.link_chars, node.link_tags = node.chars, node.tags
        if (up := node.parent) is not None:
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags + link

    def _text(self, text: str) -> None:
        if "&" in text:
            text = html.unescape(text)
        self.pieces.append(text)
        self._open[-1].chars += len("".join(text.split()))

    def _push(self, node: Node) -> None:
        self._open.append(node)
        self._tags[node.tag] += 1

    def _close(self, tags: frozenset, barrier: frozenset) -> None:
        if not any(self._tags[t] > 0 for t in tags):
            return
        for k in range(len(self._open) - 1, 0, -1):
            if self._open[k].tag in tags:
                while len(self._open) > k:
                    self._pop()
                return
            if self._open[k].tag in barrier:
                return

    def _read(self, page: str) -> None:
        at, size = 0, len(page)
        dropped, depth = "", 0
        while at < size:
            m = TOKEN.search(page, at)
            begin = m.start() if m else size
            if begin > at and not dropped:
                self._text(page[at:begin])
            if m is None:
                break
            at = m.end()
            if end := m[5]:
                end = end.lower()
                if dropped:
                    if end == dropped:
                        depth -= 1
                        if not depth:
                            dropped = ""
                    continue
                if end in ("body", "html"):
                    continue
                self._close(frozenset([end]), frozenset())
                continue
            tag = (m[1] or m[3] or "").lower()
            if not tag:
                continue
            attributes = m[2] or m[4] or ""
            closed = tag in VOID or attributes.endswith("/") and tag not in BLOCKS and tag not in RAW
            if tag in RAW:
                if not attributes.endswith("/") or tag != "iframe":
                    stop = re.compile(rf"</{tag}\s*/?>|\Z", re.IGNORECASE).search(page, at)
                    at = stop.end()
                continue
            if dropped:
                if tag == dropped and not closed:
                    depth += 1
                elif dropped == "head" and tag in ("body", "article", "main", "div", "p"):  # the head was left open
                    dropped, depth = "", 0
                else:
                    continue
                if dropped:
                    continue
            if tag == "body":
                if self.body is self.root:
                    self.body = Node("body", self._open[-1], len(self.pieces))
                    self._push(self.body)
                continue
            if tag == "html":
                continue
            if tag in CLOSES_P:
                self._close(frozenset(["p"]), BARRIER)
            if tag in IMPLIED:
                self._close(*IMPLIED[tag])
            top = self._open[-1]
            if closed:
                self.pieces.append(None if tag == "hr" else " ")
                top.tags += 1
                continue
            if unwanted(tag, attributes, top.within, top is self.body):
                dropped, depth = tag, 1
                self.pieces.append(None if tag in BLOCKS else " ")
                continue
            if tag in BLOCKS:
                self.pieces.append(None)
            self._push(Node(tag, top, len(self.pieces)))
            self._open[-1].named = named(tag, attributes, top.within)


def set_densities(tree: Tree) -> None:
    body = tree.body
    share = body.link_chars / body.chars if body.chars else 0.0
    todo = [tree.root]
    while todo:
        n = todo.pop()
        todo += n.children
        if n.chars:
            tags, links, link_tags = max(1, n.tags), max(1, n.link_chars), max(1, n.link_tags)
            plain = max(1, n.chars - n.link_chars)
            base = math.log(n.chars / plain * n.link_chars + share * n.chars + math.e)
            # a base next to 1 would blow up short texts on pages with hardly a link
            n.density = n.chars / tags * math.log(max(1.0, n.chars / links * tags / link_tags)) / max(0.5, math.log(base))


def densest(top: Node) -> Node:
    """The node of a subtree whose children's densities have the greatest sum; one without blocks below is a block of text
    itself, and only taken where there is nothing else."""
    best, most = top, -1.0
    todo = [top]
    while todo:
        n = todo.pop()
        todo += reversed(n.children)
        if any(c.tag in BLOCKS for c in n.children):
            total = sum(c.density for c in n.children)
            if total > most:
                best, most = n, total
    return best


def marked(tree: Tree, best: Node, threshold: float) -> list[Node]:
    """``best`` and the densest node of every other subtree that reaches the threshold, from the body down."""
    found, held, above = [best], {id(best)}, set()

    def note(n: Node) -> None:
        while n is not None and id(n) not in above:
            above.add(id(n))
            n = n.parent

    note(best)
    todo = list(tree.body.children)
    while todo:
        n = todo.pop()
        if id(n) in held:
            continue
        if id(n) not in above and n.chars and n.density >= threshold and 2 * n.link_chars <= n.chars:
            n_best = densest(n)
            found.append(n_best)
            held.add(id(n_best))
            note(n_best)
        todo += n.children
    return found


def article(tree: Tree) -> list[tuple[int, int]]:
    """The slices of ``pieces`` that the article consists of."""
    set_densities(tree)
    best = densest(tree.body)
    path, n = [], best
    while n is not None:
        path.append(n)
        if n is tree.body:
            break
        n = n.parent
    threshold = min(n.density for n in path)
    for n in path[1:]:
        if n.tag in ("article", "main"):
            best = n
    named = best.tag in ("article", "main")
    if not named and best is not tree.body and best.parent is not None and not best.children:
        best = best.parent
    nodes = [best] if named or best is tree.body else marked(tree, best, threshold)
    chosen = {id(n) for n in nodes}
    # the lowest node that holds all marked ones; of the rest of it, blocks of running text stay
    above: set[int] = set()
    for n in nodes:
        while n is not None and id(n) not in above:
            above.add(id(n))
            n = n.parent if n is not tree.body else None
    top = tree.body
    while id(top) not in chosen and len(down := [c for c in top.children if id(c) in above]) == 1:
        top = down[0]
    cut, todo = [], [top]
    while todo:
        n = todo.pop()
        if id(n) in chosen:
            cut += [(c.start, c.stop) for c in n.children if id(c) not in above and c.density < threshold and 2 * c.link_chars > c.chars > 0]
            todo += [c for c in n.children if id(c) in above]
        else:
            todo += [c for c in n.children if id(c) in above]
            cut += [(c.start, c.stop) for c in n.children if id(c) not in above and (c.tag not in RUNNING or 2 * c.link_chars > c.chars > 0)]
    slices, at = [], top.start
    for low, high in sorted(cut):
        slices.append((at, low))
        at = high
    return [*slices, (at, top.stop)]


def main_text(page: str | None) -> str:
    if not page:
        return ""
    tree = Tree(page)
    blocks: list[list[str]] = [[]]
    for low, high in article(tree):
        for piece in tree.pieces[low:high]:
            if piece is None:
                if blocks[-1]:
                    blocks.append([])
            else:
                blocks[-1].append(piece)
    found = (" ".join("".join(b).split()) for b in blocks)
    return "\n\n".join(x for x in found if x)


def extract(pages: DataFrame, key: str = "page_id", source: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """``key``, the columns of ``keep``, ``text`` and ``n_chars`` of each page."""
    chosen = pages.select(F.col(source).alias("page"), F.col(key).alias("key"), *(F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)))
    kinds = dict(pages.dtypes)
    schema = f"key {kinds[key]}, " + "".join(f"kept_{i} {kinds[c]}, " for i, c in enumerate(keep)) + "text string, n_chars long"

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(x) for x in batch.column(0).to_pylist()]
            return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*batch.schema.names[1:], "text", "n_chars"])

        return step

    out = arrow_map(chosen, make, schema)
    return out.select(F.col("key").alias(key), *(F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)), "text", "n_chars")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))

"""Main text of web pages by composite text density.

The page is parsed into a DOM without scripts, styles and other parts that hold
no text to read. Every node gets a density: characters per tag (those that only
form words aside), adjusted by its share of link characters and link tags against the page's. The node whose
children's densities sum highest is the heart of the article; the least density
on the path from the body to it is the threshold by which the other children of
its ancestors belong to the article too.

Menus, headers, footers, sidebars, notices, adverts, forms and reader comments
are told by their tags and roles, and by class and id words as evidence: what is
marked so is left out of the densities, unless it holds most of the page's text
with its heading, or is so much denser than the rest that the mark must be wrong.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow import map_chunks

_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|!\[CDATA\[|[!?/])")
#: One step in a tag: its end, or an attribute with the quote or the bare value after its "=".
_STEP = re.compile(r"[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:([\"'])|([^\s>]*+)))?)")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul caption".split()
)
#: Elements without text to read.
_NONE = frozenset("head script style noscript template iframe object embed svg math canvas button select textarea input audio video noembed noframes".split())
#: Elements and roles that are never the article.
_APART = frozenset("nav aside footer dialog menu".split())
_APART_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words of class and id names that speak against an element, and beginnings of such words.
_AGAINST = frozenset(
    "ad ads adsense advert banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright discussion disqus footer gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice notices notification alert overlay pager pagination paywall pop popup promo rail related replies reply respond search share sharing side sidebar signup skip social subscribe subscription toolbar topbar widget".split()
)
_AGAINST_BEGINNINGS = ("advert", "sponsor", "promo", "recommend")
#: Words that make a name tell of a state ("has-sidebar", "comments-open") and not of the element.
_STATE_FIRST = frozenset("has no with without is not show hide enable disable allow".split())
_STATE_LAST = frozenset("open closed enabled disabled on off active visible collapsed expanded loaded ready allowed".split())
#: Names that speak for an element, if it holds much of the text.
_FOR = frozenset("article articlebody body content entry hentry main page post story text".split())
_NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
#: Elements that form words, not the page: they don't count as tags.
_INLINE = frozenset("abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark picture q s samp small source span strike strong sub sup time tt u var wbr".split())
#: Elements of running text: below the body they need no density.
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote figure hr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that an opening tag closes if they are open, up to the nearest of the stops.
_CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_P_STOPS = frozenset("article aside blockquote body button div dl dd dt fieldset figure footer form header html li main nav ol section table td th tr ul".split())
_CLOSES_P = _BLOCK - frozenset("td th tr tbody thead tfoot caption option optgroup title html body legend summary".split())
#: Share of the unlinked text from which a marked element with the page's heading is the article after all.
MOST = 0.5
#: Share from which a name that speaks for an element outweighs one against it.
MUCH = 0.2
#: What the density of a marked element counts next to others'.
DOUBT = 0.1
#: Share of link characters from which a block is a menu.
LINKED = 0.5
_SENTENCE = re.compile(r"[.!?\u2026:;\"\u00bb\u201d\u3002\uff01\uff1f\u061f\u0964]\s*$")


class Node:
    __slots__ = ("tag", "children", "mark", "cut", "chars", "tags", "link_chars", "link_tags", "own", "anchor", "density", "total")

    def __init__(self, tag: str, mark: str = ""):
        self.tag, self.mark, self.cut, self.children = tag, mark, False, []  # children: nodes and strings
        self.chars = self.tags = self.link_chars = self.link_tags = self.own = 0
        self.anchor = False
        self.density = self.total = 0.0

    def nodes(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]


def _against(names: str) -> bool:
    """Whether a class or id name speaks against an element."""
    for name in names.split():
        words = [w.lower() for w in _NAME_WORDS.findall(name)]
        if words and not (words[0] in _STATE_FIRST or len(words) > 1 and words[-1] in _STATE_LAST):
            if any(w in _AGAINST or w.startswith(_AGAINST_BEGINNINGS) for w in words):
                return True
    return False


def _mark(tag: str, attrs: dict[str, str], inside: bool) -> str:
    """Why an element may not be of the article: apart (never is), form, hidden, name or named (with a name for it too)."""
    if tag in _APART or attrs.get("role", "").lower() in _APART_ROLES and tag != "form":
        return "apart"
    if tag == "form":
        return "form"
    if tag == "header" and not inside:
        return "name"
    if tag in ("html", "body", "main") or not attrs:
        return ""
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or _HIDDEN.search(attrs.get("style", "")):
        return "hidden"
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    if _against(names if not inside else re.sub(r"(?i)header", "", names)):
        return "named" if any(n.lower() in _FOR for n in names.split()) else "name"
    return ""


def _scanner(page: str) -> Callable[[int], tuple[dict[str, str], int]]:
    """A function that reads the attributes of a tag from where its name ends: (attributes, where the tag ends).

    A quote that is never closed ends with the tag. That there is no further
    quote of a kind is remembered, so the page is scanned once.
    """
    missing: dict[str, int] = {}

    def find(sign: str, at: int) -> int:
        if at >= missing.get(sign, len(page) + 1):
            return -1
        k = page.find(sign, at)
        if k < 0:
            missing[sign] = at
        return k

    def read(at: int) -> tuple[dict[str, str], int]:
        attrs: dict[str, str] = {}
        if page.startswith(">", at):
            return attrs, at + 1
        if find(">", at) < 0:
            return attrs, len(page)
        while m := _STEP.match(page, at):
            at = m.end()
            if m[1]:
                return attrs, at
            value = m[4] or ""
            if m[3]:
                close = find(m[3], at)
                if close < 0:
                    end = find(">", at)
                    return attrs, end + 1 if end >= 0 else len(page)
                value, at = page[at:close], close + 1
            attrs.setdefault(m[2].lower(), value)
        return attrs, len(page)

    return read


def parse(page: str) -> Node:
    """The DOM. Elements without text to read are left out; those that may not be of the article are marked."""
    root = Node("html")
    stack = [root]
    open_: dict[str, int] = {"html": 1}
    dropped = inside = 0  # open elements without text; open articles
    at, end = 0, len(page)
    read = _scanner(page)

    def pop() -> None:
        nonlocal dropped, inside
        node = stack.pop()
        open_[node.tag] -= 1
        dropped -= node.tag in _NONE
        inside -= node.tag in ("article", "main")

    def text(a: int, b: int) -> None:
        if a < b and not dropped:
            stack[-1].children.append(entities.unescape(page[a:b]))

    def after(sign: str, a: int) -> int:
        k = page.find(sign, a)
        return k + len(sign) if k >= 0 else end

    while at < end:
        m = _OPEN.search(page, at)
        if m is None:
            text(at, end)
            break
        text(at, m.start())
        at = m.end()
        if not m[2]:
            if m[0] == "<!--":
                at = after("-->", m.start() + 2)
            elif m[0] == "<![CDATA[":
                at = after("]]>", at)
                if not dropped:
                    stack[-1].children.append(page[m.end() : at].removesuffix("]]>"))
            elif m[0] == "</" and not page.startswith(">", at) and (at >= end or page[at].isspace()):
                text(m.start(), at)
            else:
                at = after(">", at)
            continue
        name = m[2].lower()
        attrs, at = read(at)
        if m[1]:
            if name == "br":
                stack[-1].children.append(Node("br"))
            elif name != "html" and open_.get(name):
                while stack[-1].tag != name:
                    pop()
                pop()
            continue
        if name in ("html", "body") and open_.get(name):
            continue
        if name == "body" and open_.get("head"):
            while stack[-1].tag != "head":
                pop()
            pop()
        if name in _CLOSES_P and open_.get("p"):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    while len(stack) > i:
                        pop()
                    break
                if stack[i].tag in _P_STOPS:
                    break
        if name in _CLOSES:
            shut, stops = _CLOSES[name]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in stops:
                    break
                if stack[i].tag in shut:
                    while len(stack) > i:
                        pop()
                    if name != "tr":  # a row closes the cell and the row before it
                        break
        node = Node(name, "" if dropped else _mark(name, attrs, inside > 0))
        if not dropped and name not in _NONE:
            stack[-1].children.append(node)
        if name in _VOID or name in ("svg", "path", "use") and page[at - 2 : at] == "/>":
            continue
        if name in _RAW_END:
            stop = _RAW_END[name].search(page, at)
            at = after(">", stop.end()) if stop else end
            continue
        stack.append(node)
        open_[name] = open_.get(name, 0) + 1
        dropped += name in _NONE
        inside += name in ("article", "main")
    return root


def _order(root: Node) -> list[Node]:
    """The nodes that aren't cut, parents first."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(c for c in reversed(node.nodes()) if not c.cut)
    return order


def _count(order: list[Node]) -> None:
    """Characters, tags and links below each node, without what is cut."""
    for node in reversed(order):
        node.chars = node.own
        node.tags = node.link_chars = node.link_tags = 0
        node.anchor = node.tag in ("h1", "main", "article") and not node.mark
        for c in node.nodes():
            if not c.cut:
                node.chars += c.chars
                node.tags += c.tags + (c.tag not in _INLINE)
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
                node.anchor |= c.anchor
        if node.tag == "a":
            node.link_chars = node.chars


def _weigh(order: list[Node]) -> Node:
    """Densities and sums of the nodes; returns the node of greatest sum."""
    root = order[0]
    body_share = root.link_chars / root.chars if root.chars else 0.0
    for node in order:
        node.density = 0.0
        if node.chars:
            c, t, lc, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
            base = math.log(c / max(1, c - lc) * lc + body_share * c + math.e)
            density = c / t * math.log(max(1.0, c / lc * t / lt) + 1e-9)
            node.density = max(0.0, density / math.log(base))
    for node in order:
        node.total = sum(c.density for c in node.nodes() if not c.cut and (c.tags or c.tag not in _INLINE))
    return max(order, key=lambda n: n.total)


def _settle(root: Node) -> Node | None:
    """Cuts off the marked elements that aren't of the article; returns the heart, None for a page without text."""
    every = _order(root)
    for node in every:
        node.own = sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        node.cut = node.mark == "apart"
    order = _order(root)
    _count(order)
    plain = {id(n): n.chars - n.link_chars for n in order}
    within: set[int] = set()  # below an element that its name alone speaks against
    whole = plain[id(root)]
    for n in order:
        names = n.mark == "name" and not n.anchor
        if names and id(n) not in within:
            whole -= plain[id(n)]
        if names or id(n) in within:
            within.update(id(c) for c in n.nodes())
    doubtful = []
    for node in order:
        if node.mark and plain[id(node)] < whole * (MUCH if node.mark == "named" else MOST) or node.mark == "name" and not node.anchor:
            node.cut = True
            doubtful.append(node)
    while True:
        order = _order(root)
        _count(order)
        heart = _weigh(order)
        # a marked element that is much denser than all that is left was marked wrongly
        best, most = None, heart.total
        for node in doubtful:
            if node.cut and plain[id(node)] > plain[id(root)] * MOST:
                below = _order(node)
                _count(below)
                if (top := _weigh(below).total * DOUBT) > most or not root.chars:
                    best, most = node, top
        if best is None:
            break
        best.cut = False
    if not root.chars:
        # nothing but marked elements: names don't count then
        for node in doubtful:
            node.cut = False
        order = _order(root)
    _count(order)
    heart = _weigh(order)
    return heart if root.chars else None


def _text(node: Node) -> str:
    return " ".join("".join(c if isinstance(c, str) else " " for n in _order(node) for c in n.children).split())


def _heading(node: Node) -> bool:
    """A heading, or a block of headings only."""
    return node.tag in _HEADINGS or node.chars > 0 and node.chars == sum(n.chars for n in _order(node) if n.tag in _HEADINGS)


def _menu(node: Node) -> bool:
    """A block of several links and little else."""
    return node.tag in _BLOCK and node.tag != "p" and node.link_tags > 1 and node.link_chars > LINKED * node.chars


def _blocks(keep: list) -> list[str]:
    """The texts of the blocks below the given nodes and strings, in page order."""
    out: list[str] = []
    run: list[str] = []

    def cut() -> None:
        if words := "".join(run).split():
            out.append(" ".join(words))
        run.clear()

    todo: list = list(reversed(keep))
    while todo:
        item = todo.pop()
        if item is None:
            cut()
        elif isinstance(item, str):
            run.append(item)
        elif item.tag == "br":
            run.append(" ")
        else:
            block = item.tag in _BLOCK
            if block:
                cut()
            if item.cut or _menu(item):
                continue
            if block:
                todo.append(None)
            todo.extend(reversed(item.children))
    cut()
    return out


def main_text(page: str | None) -> str:
    """The article of a page: its blocks joined by blank lines; empty for no page or no text."""
    if not page:
        return ""
    root = parse(page)
    heart = _settle(root)
    if heart is None:
        return ""
    order = _order(root)
    body = next((n for n in order if n.tag == "body" and n.chars), root)
    parent = {id(c): n for n in order for c in n.nodes()}
    path = [heart]
    while path[-1] is not body and id(path[-1]) in parent:
        path.append(parent[id(path[-1])])
    threshold = min(n.density for n in path)
    titled = any(n.tag == "h1" for n in _order(heart))
    found: list = [heart]
    if heart is body:
        # blocks that aren't running text must be as dense as the body
        found = [c for c in body.children if isinstance(c, str) or c.cut or not c.chars or c.tag in _TEXT or c.tag not in _BLOCK or c.density >= threshold]
    for below, node in zip(path, path[1:], strict=False):
        around: list = []
        for c in node.children:
            if c is below:
                around += [None, *found, None] if c.tag in _BLOCK else found
            elif isinstance(c, str) or c.tag == "br" or not c.chars:
                around.append(c if isinstance(c, str) or c.tag == "br" else None)
            elif c.cut or c.link_chars > LINKED * c.chars:
                around.append(None)
            # short blocks beside the heart belong to it below the body, if they read as text
            elif c.density >= threshold or _heading(c) and (not titled or node is not body and c.tag in _HEADINGS) or node is not body and node.tag != "html" and _SENTENCE.search(_text(c)):
                around.append(c)
            elif c.tag in _BLOCK:
                around.append(None)
        found = around
    return "\n\n".join(_blocks(found))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    A null or empty page, or one without text, gives an empty text and 0. Null
    ids and urls and repeated rows are kept; an empty table gives no rows;
    broken markup is read as browsers do, as far as it matters for text.
    """

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h) for h in part.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return map_chunks(rows, run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long", "html")

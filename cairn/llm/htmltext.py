"""Main text of web pages by composite text density.

A page becomes a tree.  Each node's density is its characters per tag, adjusted for the share that
lies in links; a node's density sum is the sum of its children's densities.  The container with
the largest sum is the main one, and an article or main element round it is taken whole.  The
smallest density on the path from body to it is the threshold: without such an element, siblings
along the path count as main text too if their density reaches the threshold.  Menus, page
headers, footers, forms, scripts and styles are cut off before; so is what a class, id or role
names as a sidebar, notice, advert, reader comments and the like, unless it is or holds the main
text (`resolve`).

Defined results: a null, empty or tag-only page gives an empty text; broken markup (open tags,
stray end tags, a cut-off page) is read as browsers do in the common cases; repeated rows give
repeated results; columns beyond page_id, url and html are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_TAG = re.compile(
    r"<!--(?:.*?)(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)",
    re.S,
)
_SPACE = re.compile(r"\s+")
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([a-zA-Z-]+)")
_WORDS = re.compile(r"[a-z]+")

# Elements of HTML by what they do here.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg".split())
_CUT = frozenset("script style textarea title noscript template iframe svg head nav footer aside form button select option input dialog menu".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_CONTAINER = frozenset("html body main article section div td center table tbody tr blockquote".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_CLOSES = {  # a start tag ends an open element of these kinds, up to a boundary
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_ENDS_P = _BLOCK - frozenset(["html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"])
_P_SCOPE = frozenset("html body td th caption table button object article section div li blockquote main aside nav footer header form".split())
# Words in class, id and role that mark what is not the article.
_HINTS = frozenset(
    """ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary consent contentinfo
    cookie cookies copyright disqus footer gdpr menu modal nav navbar navigation newsletter notice notices popup promo promoted
    promotion related recommended replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe
    toolbar widget widgets alert dialog""".split()
)
# Of these, words that also begin names of an article's own parts; there the share of links decides.
_LOOSE = frozenset("alert dialog notice notices promoted recommended related respond search share sharing social".split())
WHOLE, MIXED, LOOSE = 1, 2, 3


class Node:
    __slots__ = ("tag", "parent", "kids", "cut", "chars", "links", "tags", "link_tags", "density", "sum", "heads", "hint")

    def __init__(self, tag: str, parent: Node | None, cut: bool):
        self.tag, self.parent, self.cut = tag, parent, cut
        self.kids: list = []  # nodes and strings
        self.chars = self.links = self.tags = self.link_tags = 0
        self.density = self.sum = 0.0
        self.heads = False
        self.hint = 0


def _unwanted(tag: str, attrs: str) -> tuple[bool, int]:
    """(cut off for certain, what class, id and role hint at: WHOLE, MIXED, LOOSE or 0).  Hidden text is text."""
    if tag in _CUT:
        return True, 0
    if not attrs or tag in ("html", "body", "main"):
        return False, 0
    firm = loose = other = False
    for name, a, b, c, bare in _ATTR.findall(attrs):
        name, value = (name or bare).lower(), (a or b or c).lower()
        if name in ("class", "id", "role"):
            if _WORDS.findall(value) in (["header"], ["masthead"], ["page", "header"], ["site", "header"]):
                firm = True
                continue
            for token in value.split():
                said = _WORDS.findall(token)
                if said and said[0] in _HINTS and (len(said) == 1 or said[0] not in _LOOSE):
                    firm = True
                else:
                    loose |= not _HINTS.isdisjoint(said)
                    other |= bool(said) and name == "class"
    return False, (MIXED if other else WHOLE) if firm else LOOSE if loose else 0


def parse(page: str) -> Node:
    """The page's tree; cut-off parts are empty nodes with cut set."""
    root = Node("html", None, False)
    body = Node("body", root, False)
    root.kids.append(body)
    top, at, end = body, 0, len(page)
    open_ended: set[str] = set()  # elements of raw text that are not closed any more

    def text(s: str) -> None:
        if s:
            top.kids.append(html.unescape(s) if "&" in s else s)

    while at < end:
        m = _TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            node = top
            while node is not body and node.tag != tag:
                node = node.parent
            if node is not body:
                inside = node
                if tag not in _BLOCK:  # an inline end tag doesn't end a block
                    inside = top
                    while inside is not node and inside.tag not in _BLOCK:
                        inside = inside.parent
                if inside is node:
                    top = node.parent
            continue
        if tag in ("html", "body", "head") or tag.startswith("!"):
            if tag == "head":
                close = re.compile(r"</head\s*>|<body", re.I).search(page, at)
                if close:
                    at = close.end() if close[0].startswith("</") else close.start()
            continue
        attrs = m[3] or m[6] or ""
        if tag in _RAW:
            close = None if tag in open_ended else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if not close:
                open_ended.add(tag)
            at = close.end() if close else (end if tag in ("script", "style") else at)
            top.kids.append(Node(tag, top, True))
            continue
        if tag in _ENDS_P:
            node = top
            while node is not body and node.tag != "p" and node.tag not in _P_SCOPE:
                node = node.parent
            if node.tag == "p":
                top = node.parent
        if tag in _CLOSES:
            kinds, bound = _CLOSES[tag]
            node = top
            while node is not body and node.tag not in kinds and node.tag not in bound:
                node = node.parent
            if node.tag in kinds:
                top = node.parent
        sure, hint = _unwanted(tag, attrs)
        node = Node(tag, top, top.cut or sure)
        node.hint = hint
        top.kids.append(node)
        if tag not in _VOID and not attrs.endswith("/"):
            top = node
    return root


def _prune_headers(node: Node) -> None:
    """A header element is cut off outside an article; the article's own, with its title and standfirst, stays."""
    todo = [node]
    while todo:
        n = todo.pop()
        if n.tag == "header":
            n.cut = True
        elif n.tag not in ("article", "main"):
            todo += [k for k in n.kids if isinstance(k, Node) and not k.cut]


def measure(root: Node) -> None:
    """Densities and density sums of all nodes, children first."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += [k for k in n.kids if isinstance(k, Node) and not k.cut]
    for n in reversed(order):
        n.chars = n.links = n.tags = n.link_tags = 0
        n.density, n.heads = 0.0, False
        for k in n.kids:
            if isinstance(k, str):
                n.chars += len(_SPACE.sub(" ", k).strip())
            elif not k.cut:
                n.chars += k.chars
                n.links += k.links
                n.tags += k.tags + 1
                n.link_tags += k.link_tags + (k.tag == "a")
                n.heads |= k.heads or k.tag in _HEADING
        if n.tag == "a":
            n.links = n.chars
    whole = max(1, root.chars)
    share = root.links / whole
    for n in reversed(order):
        c, t, lc, lt = n.chars, max(1, n.tags), max(1, n.links), max(1, n.link_tags)
        if c:
            free = max(1, c - n.links)
            base = math.log(c * n.links / free + share * c + math.e)
            n.density = c / t * math.log(max(1.0, c / lc * t / lt) + 1e-9, max(base, 1.0001)) if c != n.links else 0.0
        n.sum = sum(k.density for k in n.kids if isinstance(k, Node) and not k.cut)


def _nodes(root: Node) -> Iterator[Node]:
    todo = [root]
    while todo:
        n = todo.pop()
        yield n
        todo += [k for k in n.kids if isinstance(k, Node) and not k.cut]


def _densest(root: Node) -> Node:
    best = root
    for n in _nodes(root):
        if n.tag in _CONTAINER and (n.sum, n.chars) > (best.sum, best.chars):
            best = n
    return best


def resolve(root: Node) -> None:
    """Cut off what hints name, but never main or the page's article, nor what holds them.

    A node whose class has other words too stays if it is or holds the densest part of the page,
    and so does any node if nothing else has text.  A word within a compound name is no more than
    a hint at a list of links: half of the text has to be linked.
    """
    nodes = list(_nodes(root))
    hinted = [n for n in nodes if n.hint]
    if not hinted:
        return
    measure(root)

    def add_path(to: set[int], n: Node | None) -> set[int]:
        while n is not None and id(n) not in to:
            to.add(id(n))
            n = n.parent
        return to

    dense, held = add_path(set(), _densest(root)), set()
    for n in nodes:
        if n.tag == "main" or (n.tag == "article" and n.hint != WHOLE and (id(n) in dense or 2 * n.chars >= root.chars)):
            add_path(held, n)
    gone = []
    for n in hinted:
        if id(n) in held or (n.hint != WHOLE and id(n) in dense) or (n.hint == LOOSE and 2 * n.links < n.chars):
            continue
        n.cut = True
        gone.append(n)
    if gone and not any(isinstance(k, str) and k.strip() for n in _nodes(root) for k in n.kids):
        for n in gone:
            n.cut = id(n) not in dense


def select(root: Node) -> list[Node]:
    """The nodes that hold the main text, in page order."""
    _prune_headers(root)
    resolve(root)
    measure(root)
    best = _densest(root)
    path = []
    n = best
    while n is not None:
        path.append(n)
        n = n.parent
    for n in reversed(path):  # the outermost article or main
        if n.tag in ("article", "main"):
            return [n]
    threshold = min(n.density for n in path)
    chosen = [best]
    for n, inner in zip(path[1:], path, strict=False):
        sides: tuple[list[Node], list[Node]] = ([], [])
        after = 0
        for k in n.kids:
            if k is inner:
                after = 1
            elif isinstance(k, Node) and not k.cut and k.chars and k.tag != "a" and k.density >= threshold:
                sides[after].append(k)
        chosen = [*sides[0], *chosen, *sides[1]]
    return chosen


def blocks(nodes: list[Node]) -> list[str]:
    """The text blocks under the nodes: white space is one space, ends are trimmed, none is empty."""
    out: list[str] = []
    now: list[str] = []

    def flush() -> None:
        s = _SPACE.sub(" ", "".join(now)).strip()
        now.clear()
        if s:
            out.append(s)

    for node in nodes:
        flush()
        todo: list = [node]
        while todo:
            k = todo.pop()
            if k is None:
                flush()
            elif isinstance(k, str):
                now.append(k)
            elif k.cut:
                if k.tag in _BLOCK:
                    flush()
            elif k.tag == "br":
                now.append(" ")
            elif k.tag in _BLOCK:
                flush()
                todo.append(None)
                todo += reversed(k.kids)
            else:
                todo += reversed(k.kids)
        flush()
    return out


def main_text(page: str | None) -> str:
    return "\n\n".join(blocks(select(parse(page)))) if page else ""


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [main_text(x) for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    from pyspark.sql import functions as F

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_run, "page_id long, url string, text string, n_chars long")

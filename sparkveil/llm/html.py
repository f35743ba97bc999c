"""HTML extraction by composite text density.

A page becomes a tree of elements; only what is never seen as text (scripts, styles, hidden elements) is cut from it. Each
node has a composite density, its characters per tag, adjusted for characters and tags of links; block tags and links count,
inline markup does not. What tag, role or name call a menu, header, footer, sidebar, notice, advert, form or comment weighs
like the text of links. The node whose children's densities sum highest holds the main text; the smallest density on its path
to the body is the threshold by which its ancestors' other children join it, and under which weighed elements and lists of
links within it fall.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sliced, texts_of

# What begins a comment, a declaration or a tag, and the rest of a tag: quotes count after "=" only, as in
# browsers. Possessive, so that no pattern looks at a character twice from the same start.
BEGIN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*+))")
REST = re.compile(r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
ATTRIBUTE = re.compile(r"([^\s=/\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option".split()
)
#: An opening tag of the key ends open elements of the value, up to the nearest of `SCOPES`.
ENDS = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
SCOPES = frozenset("ul ol dl table tbody thead tfoot select body html article section div main td th".split())
CLOSES_P = BLOCKS - frozenset(["td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "body", "html", "legend"])

#: What browsers don't show as text.
UNSEEN = frozenset("script style noscript template iframe object embed svg canvas audio video map head title noembed noframes xmp".split())
LISTS = frozenset("ul ol dl menu".split())

# What pages call their boilerplate: it weighs like links.
DROP_TAGS = frozenset("nav aside footer form fieldset button select input textarea label dialog menu".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
DROP_WORDS = frozenset(
    "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs header masthead banner topbar footer bottombar copyright sidebar aside widget widgets rail "
    "related recommended recommendations more-stories notice notices cookie cookies consent gdpr announcement disclaimer alert popup modal overlay newsletter subscribe subscription signup login "
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted "
    "comment comments commentlist disqus replies respond discussion share sharing social pager pagination skip-link toolbar form search searchbox hidden sr-only".split()
)
#: A name made of parts goes if its first or last part is one of the words, unless that alone says too little ...
WEAK = frozenset(["header", "form", "more", "search", "hidden", "alert", "rail", "discussion", "respond", "replies"])
#: ... but these do go, and names that begin with one of `ABOUT` only tell what an element has or lacks.
WHOLE = frozenset(
    "site-header page-header global-header main-header top-header search-form search-box login-form contact-form signup-form comment-form "
    "site-notice legal-notice back-to-top".split()
)
ABOUT = frozenset(["has", "no", "with", "without", "is", "not"])
LEVELS = frozenset(f"h{i}" for i in range(1, 7))
P = frozenset(["p"])
LOOSE = re.compile(r"([^>]*+)>")


class Node:
    __slots__ = ("tag", "attributes", "children", "parent", "chars", "tags", "link_chars", "link_tags", "blocks", "density", "holds_main", "in_main", "weighed")

    def __init__(self, tag: str, attributes: str, parent: Node | None, in_main: bool = False) -> None:
        self.tag, self.attributes, self.parent, self.in_main = tag, attributes, parent, in_main
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = self.blocks = 0
        self.density = 0.0
        self.holds_main = self.weighed = False


class Open:
    """The open elements, with their depths by tag: no question walks up the tree, and each element is
    closed once, so parsing takes time in proportion to the page."""

    def __init__(self, root: Node) -> None:
        self.stack = [root]
        self.depths: defaultdict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        self.scopes: list[int] = []

    def has(self, tag: str) -> bool:
        return bool(self.depths[tag])

    def push(self, node: Node) -> None:
        depth = len(self.stack)
        self.stack.append(node)
        self.depths[node.tag].append(depth)
        if node.tag in BLOCKS:
            self.blocks.append(depth)
        if node.tag in SCOPES:
            self.scopes.append(depth)

    def cut(self, depth: int) -> None:
        """Close the elements at `depth` and deeper."""
        while len(self.stack) > depth:
            tag = self.stack.pop().tag
            self.depths[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()
            if tag in SCOPES:
                self.scopes.pop()

    def end(self, tag: str) -> None:
        """A closing tag: inline ones don't reach over an open block, and strays are ignored."""
        depth = self.depths[tag][-1] if self.depths[tag] else 0
        if depth and (tag in BLOCKS or not self.blocks or self.blocks[-1] < depth):
            self.cut(depth)

    def finish(self, tags: frozenset[str]) -> None:
        """Close the nearest open element of `tags` in scope, and those of `tags` right around it."""
        depth = max((self.depths[t][-1] for t in tags if self.depths[t]), default=0)
        if depth and depth >= (self.scopes[-1] if self.scopes else 0):
            self.cut(depth)
            while self.stack[-1].tag in tags:
                self.cut(len(self.stack) - 1)


def parse(page: str) -> Node:
    """A tree under a root without tag. Tags that never close end with their parents; stray closing tags
    are ignored; `<p>` ends where a block begins. Where no tag can end outside quotes any more, quotes stop
    counting; a tag without any end is text."""
    root = Node("", "", None)
    at, still, rest = 0, Open(root), REST
    while True:
        m = BEGIN.search(page, at)
        here = still.stack[-1]
        if m is None:
            here.children.append(page[at:])
            return root
        if m.start() > at:
            here.children.append(page[at : m.start()])
        if m[1] or m[2]:
            end = page.find("-->" if m[1] else ">", m.end())
            at = end + (3 if m[1] else 1) if end >= 0 else len(page)
            continue
        body = rest.match(page, m.end())
        if body is None:
            rest = LOOSE
            body = rest.match(page, m.end())
        if body is None:
            here.children.append(page[m.start() :])
            return root
        at, tag, attributes = body.end(), m[4].lower(), body[1]
        if m[3]:
            still.end(tag)
            continue
        if tag in ("html", "body", "head") and still.has(tag):
            continue
        if tag in CLOSES_P:
            still.finish(P)
        if tag in ENDS:
            still.finish(ENDS[tag])
        here = still.stack[-1]
        if tag in LEVELS and here.tag in LEVELS or tag == "body" and here.tag == "head":
            still.cut(len(still.stack) - 1)
            here = still.stack[-1]
        node = Node(tag, attributes, here, still.has("article") or still.has("main"))
        here.children.append(node)
        if tag == "main" or tag == "article" and not (attributes and _named(node)):
            outer = here
            while outer is not None and not outer.holds_main:  # what holds the article is not boilerplate by name
                outer.holds_main = True
                outer = outer.parent
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS and tag not in RAW and tag != "a":
            continue
        if tag in RAW:
            end = _end_of(tag).search(page, at)
            node.children.append(page[at : end.start()] if end else page[at:])
            close = page.find(">", end.end()) if end else -1
            at = close + 1 if close >= 0 else len(page)
            continue
        still.push(node)


@cache
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I)


def _names(value: str) -> bool:
    for name in value.lower().split():
        if name in DROP_WORDS or name in WHOLE:
            return True
        parts = [x for x in re.split(r"[-_:.]+", re.sub(r"\d+$", "", name)) if x]
        if parts and parts[0] not in ABOUT and "with" not in parts and {parts[0], parts[-1]} & (DROP_WORDS - WEAK):
            return True
    return False


def _named(node: Node) -> bool:
    """Whether class or id call the element boilerplate."""
    return any(m[1].lower() in ("class", "id") and _names(html.unescape(m[2] or m[3] or m[4] or "")) for m in ATTRIBUTE.finditer(node.attributes))


def unseen(node: Node) -> bool:
    """Whether the element is not shown as text."""
    if node.tag in UNSEEN:
        return True
    for m in ATTRIBUTE.finditer(node.attributes) if node.attributes and node.tag not in ("html", "body", "main") else ():
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def boilerplate(node: Node) -> bool:
    """Whether tag, role, class or id call the element none of the main text."""
    if node.tag in DROP_TAGS or node.tag == "header" and not node.in_main:
        return True
    if not node.attributes or node.tag in ("html", "body", "main"):
        return False
    if not node.holds_main and _named(node):
        return True
    return any(m[1].lower() == "role" and (m[2] or m[3] or m[4] or "").strip().lower() in DROP_ROLES for m in ATTRIBUTE.finditer(node.attributes))


def _postorder(root: Node) -> list[Node]:
    """The nodes that show, children before parents; what does not is cut from the tree."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        node.children = [c for c in node.children if isinstance(c, str) or not unseen(c)]
        for c in node.children:
            if not isinstance(c, str):
                c.weighed = node.weighed or boilerplate(c)
                stack.append(c)
    return out[::-1]


def measure(nodes: list[Node]) -> None:
    """Counts and composite density of every node (children come first)."""
    for n in nodes:
        for c in n.children:
            if isinstance(c, str):
                n.chars += len("".join(html.unescape(c).split()))
            else:
                block = c.tag in BLOCKS
                n.chars, n.tags, n.blocks = n.chars + c.chars, n.tags + c.tags + (block or c.tag == "a"), n.blocks + c.blocks + block
                n.link_chars, n.link_tags = n.link_chars + c.link_chars, n.link_tags + c.link_tags
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.link_tags + 1
        if n.weighed:
            n.link_chars, n.link_tags = n.chars, max(n.tags, 1)
    body = nodes[-1]
    share = body.link_chars / max(body.chars, 1)
    for n in nodes:
        if not n.chars:
            continue
        tags, links, link_tags = max(n.tags, 1), max(n.link_chars, 1), max(n.link_tags, 1)
        base = math.log(n.chars / max(n.chars - n.link_chars, 1) * n.link_chars + share * n.chars + math.e)
        ratio = n.chars / links * (tags / link_tags)
        n.density = n.chars / tags * max(math.log(max(ratio, 1.0)) / base, 0.0)


def _titled(node: Node) -> bool:
    """A first-level heading, or an element around one: short, but the text's own title."""
    return node.tag == "h1" or any(not isinstance(c, str) and c.tag == "h1" for c in node.children)


def density_sum(node: Node) -> float:
    """The densities of the children, where text and inline elements right under the node count once, with the
    node's own density."""
    total, own = 0.0, False
    for c in node.children:
        if isinstance(c, str):
            own = own or not c.isspace()
        elif c.blocks or c.tag in BLOCKS:
            total += c.density
        else:
            own = own or c.chars > 0
    return total + node.density if own else total


def _falls(node: Node, threshold: float) -> bool:
    """Whether an element within the main block is under the threshold for its links, or for what weighs like them. A lone
    link is no menu."""
    return node.density < threshold and (node.weighed or node.tag in LISTS and node.link_tags > 1 and node.link_chars * 2 >= node.chars)


def dense_nodes(nodes: list[Node]) -> tuple[list[Node], float]:
    """Of measured nodes, children first, the subtrees of the main text in page order: the block with the highest density sum
    (of equal ones the outermost), and on its path to the body what is as dense as the path's threshold or holds the title; and
    the threshold."""
    best, most = None, 0.0
    for n in nodes:
        if n.tag not in BLOCKS or n.tag == "html":
            continue
        total = density_sum(n)
        if total >= most and total > 0:
            best, most = n, total
    best = best or nodes[-1]
    path, node = [best], best
    while node.parent is not None and node.tag != "body":
        node = node.parent
        path.append(node)
    threshold = min(n.density for n in path) or math.inf  # text of links alone has no density
    on_path = {id(n) for n in path}
    chosen: list[Node] = []
    stack = [path[-1]]
    while stack:
        node = stack.pop()
        if node is best or id(node) not in on_path:
            chosen.append(node)
            continue
        dense = lambda c: c.chars and c.link_chars * 2 < c.chars and (c.density >= threshold or _titled(c))
        joins = lambda c: id(c) in on_path or c.tag in BLOCKS and dense(c)
        stack += [c for c in node.children[::-1] if not isinstance(c, str) and joins(c)]
    return chosen, threshold


def main_nodes(page: str) -> list[Node]:
    """The subtrees of the main text, in page order, without what falls in them."""
    nodes = _postorder(parse(page))
    measure(nodes)
    chosen, threshold = dense_nodes(nodes)
    stack = list(chosen)
    while stack:
        node = stack.pop()
        node.children = [c for c in node.children if isinstance(c, str) or not _falls(c, threshold)]
        stack += [c for c in node.children if not isinstance(c, str)]
    return chosen


def blocks(nodes: list[Node]) -> list[str]:
    """The text blocks under `nodes`: references decoded, white space single, empty ones left out."""
    out: list[str] = []
    held: list[str] = []

    def close() -> None:
        if text := " ".join(html.unescape("".join(held)).split()):
            out.append(text)
        held.clear()

    for root in nodes:
        stack: list[Node | str | None] = [root]
        while stack:
            item = stack.pop()
            if item is None:
                close()
            elif isinstance(item, str):
                held.append(item)
            elif item.tag in BLOCKS:
                close()
                stack += [None, *item.children[::-1]]
            elif item.tag == "br":
                held.append(" ")
            else:
                stack += item.children[::-1]
        close()
    return out


def main_text(page: str) -> str:
    """The main text of a page, blocks joined by an empty line; empty if there is none."""
    return "\n\n".join(blocks(main_nodes(page)))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """One row per page: key, url, text, n_chars (code points). The whole html is read, however long;
    null html counts as empty and gives an empty text; repeated rows repeat. Of blocks with equal sums the outermost counts. An
    empty table gives no rows. Columns beside the three may have any name and are not kept."""
    base = pages.select(F.col(f"`{key}`"), F.col(f"`{url}`"), F.col(f"`{body}`"))
    schema = T.StructType([base.schema[key], base.schema[url], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, body):
            texts = [main_text(t) for t in texts_of(b, body)]
            yield pa.RecordBatch.from_arrays([b.column(key), b.column(url), pa.array(texts), pa.array([len(t) for t in texts], pa.int64())], names=[key, url, "text", "n_chars"])

    return base.mapInArrow(run, schema)

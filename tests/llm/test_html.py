from __future__ import annotations

import html
import math
import random
import re
import time
from html.parser import HTMLParser

import pytest

from sparkveil.llm import html as extraction

LONG = "This sentence belongs to the article and is long enough to count. " * 4


@pytest.mark.parametrize(("page", "expected"), [
    ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>one<p>two", "one\n\ntwo"), ("<div></div>", ""), ("<p>a<br>b&nbsp; c</p>", "a b c"),
    (f"<nav><a href=/>x</a></nav><header>Site</header><main><h1>T</h1><p>{LONG}</p></main><footer>f</footer>", f"T\n\n{LONG.strip()}"),
    (f"<div class='sidebar'><p>{LONG * 3}</p></div><div><p>{LONG}</p><p>More of it.</p></div>", f"{LONG.strip()}\n\nMore of it."),
    (f"<article><h1>T</h1><p>{LONG}</p><section class=comments><p>{LONG * 5}</p></section><form><p>{LONG}</p></form></article>", f"T\n\n{LONG.strip()}"),
    (f"<div id=cookie-banner>{LONG}</div><article><p>Short.</p></article><div class='ad-slot'>{LONG}</div>", "Short."),
    (f"<div class='page-wrap nav-open'><div class='site-header'>{LONG}</div><div class='content with-sidebar'><article><p>Text.</p></article></div></div>", "Text."),
    (f"<main><p>{LONG}</p><div id='comments-4'><article class='comment'><p>{LONG * 9}</p></article></div></main><div class='search-form'>q</div>", LONG.strip()),
    (f"<div class=entry-header><h1>Head</h1></div><div class=body><p>{LONG}</p><p>{LONG}</p></div><div class='post-comments'><p>{LONG * 9}</p></div>", f"Head\n\n{LONG.strip()}\n\n{LONG.strip()}"),
    ("<article><p><b>open<br><p>next</article>", "open\n\nnext"), ("<script>if (a<b) '</p>'</script><p>t</p><!-- <p>no</p> -->", "t"), ("<p>x</p", "x</p"), ("<p title='a>b'>x</p>", "x"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"), ("<p>5 < 6 & 7 > 2</p>", "5 < 6 & 7 > 2"),
])
def test_pages(page, expected):
    if page == "<p>x</p":
        assert extraction.main_text(page).startswith("x")
    else:
        assert extraction.main_text(page) == expected


def test_deep_and_long():
    assert extraction.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert extraction.main_text("<p>" + "w " * 200_000) == ("w " * 200_000).strip()
    assert extraction.main_text("<b>" * 5000 + "x") == "x"


def test_link_lists_lose_to_text():
    links = "".join(f"<li><a href=/{i}>a link with a long caption {i}</a></li>" for i in range(60))
    assert extraction.main_text(f"<div><ul>{links}</ul></div><div><p>{LONG}</p><p>{LONG}</p></div>") == f"{LONG.strip()}\n\n{LONG.strip()}"


def plain(page):
    """The article of the tables' pages, by their known form."""
    m = re.search(r"<article>(.*?)</article>", page or "", re.S)
    parts = re.split(r"</?(?:p|h1)>", m[1]) if m else []
    return "\n\n".join(t for p in parts if (t := " ".join(html.unescape(re.sub(r"</?b>", "", p.replace("<br>", " "))).split())))


def test_query_equals_plain(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in extraction.extract(pages).collect()}
    assert got == {r.page_id: (plain(r.html), len(plain(r.html))) for r in pages.collect()}


def test_rows(spark):
    rows = spark.createDataFrame([(1, "u", None, 9), (1, "u", None, 9), (None, None, "<p>x", 9)], "page_id long, url string, html string, n_chars int")
    assert sorted(map(tuple, extraction.extract(rows).collect()), key=repr) == sorted([(1, "u", "", 0), (1, "u", "", 0), (None, None, "x", 1)], key=repr)
    assert extraction.extract(rows.limit(0)).count() == 0


class Tree(HTMLParser):
    """A plain tree (tag, children) of a well-formed page."""

    def __init__(self):
        super().__init__()
        self.stack = [("", [])]

    def handle_starttag(self, tag, attrs):
        node = (tag, [])
        self.stack[-1][1].append(node)
        self.stack.append(node)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        self.stack[-1][1].append(data)


def text_of(node):
    return node if isinstance(node, str) else "".join(map(text_of, node[1]))


def under(node):
    return [] if isinstance(node, str) else [x for c in node[1] if not isinstance(c, str) for x in (c, *under(c))]


def counts(node):
    """Characters, block and link tags below, characters and tags of links, each from its definition."""
    links = [n for n in ([node] if node[0] == "a" else []) + under(node) if n[0] == "a"]
    size = lambda n: len("".join(text_of(n).split()))
    return size(node), sum(n[0] in extraction.BLOCKS or n[0] == "a" for n in under(node)), sum(map(size, links)), len(links)


def plain_best(root):
    """The chosen block by the formulas, every count taken from the whole subtree again."""
    chars, _, link_chars, _ = counts(root)
    share = link_chars / max(chars, 1)

    def density(node):
        c, t, lc, lt = counts(node)
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
        return c / max(t, 1) * max(math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1.0)) / base, 0.0)

    def total(node):
        blocks = [c for c in node[1] if not isinstance(c, str) and any(n[0] in extraction.BLOCKS for n in (c, *under(c)))]
        own = any(text_of(c).strip() for c in node[1] if not any(c is b for b in blocks))
        return sum(map(density, blocks)) + (density(node) if own else 0.0)

    candidates = [n for n in under(root) if n[0] in extraction.BLOCKS and n[0] != "html"]
    most = max((total(n) for n in candidates), default=0.0)
    return next((n for n in candidates if math.isclose(total(n), most)), None) if most else None


def some_page(rng, depth=0):
    words = lambda: " ".join("".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 30)))
    out = []
    for _ in range(rng.randrange(1, 5)):
        kind = rng.choice(["div", "section", "p", "ul", "b", ""]) if depth < 4 else rng.choice(["p", ""])
        if kind == "":
            out.append(words())
        elif kind in ("p", "b"):
            out.append(f"<{kind}>{words()}{f'<a>{words()}</a>' if rng.random() < 0.3 else ''}</{kind}>")
        elif kind == "ul":
            out.append("<ul>" + "".join(f"<li><a>{words()}</a></li>" for _ in range(rng.randrange(1, 6))) + "</ul>")
        else:
            out.append(f"<{kind}>{some_page(rng, depth + 1)}</{kind}>")
    return "".join(out)


def test_choice_equals_plain_density():
    rng = random.Random(12)
    for _ in range(300):
        page = f"<html><body>{some_page(rng)}</body></html>"
        tree = Tree()
        tree.feed(page)
        best = plain_best(tree.stack[0])
        nodes = extraction._postorder(extraction.parse(page))
        extraction.measure(nodes)
        got = ["".join(extraction.blocks([n])).replace(" ", "") for n in extraction.dense_nodes(nodes)[0]]
        assert best is None or any("".join(text_of(best).split()) in "".join(g.split()) for g in got), page


def test_density_takes_menus_adverts_and_footers_away(spark):
    """Nothing that shows is cut before densities are taken: what the whole body would give is another text on every page."""
    pages = [r.html or "" for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("html").collect()]
    shown = lambda page: "\n\n".join(extraction.blocks([extraction._postorder(extraction.parse(page))[-1]]))
    assert sum(extraction.main_text(p) != shown(p) for p in pages) == sum("<nav>" in p for p in pages) > 2000


@pytest.mark.parametrize(("page", "expected"), [
    (f"<div><p>{LONG}</p><ul><li><a href=/a>one thing</a><li><a href=/b>another</a></ul><p>{LONG}</p></div>", f"{LONG.strip()}\n\n{LONG.strip()}"),  # a menu without a name
    (f"<div><p>{LONG}</p><p><a href=/a>a lone link</a></p><ul><li>plain</li><li>list</li></ul></div>", f"{LONG.strip()}\n\na lone link\n\nplain\n\nlist"),
    (f"<article><p>{LONG}</p><p>a <span class=share>Share it</span> b</p></article>", f"{LONG.strip()}\n\na b"),
    ("<nav><p>" + LONG * 9 + "</p></nav>", ""), ("<div><a href=/>only a link</a></div>", "only a link"), (f"<aside><div><p>{LONG * 9}</p><p>{LONG * 9}</p></div></aside><p>Text.</p>", "Text."),
])
def test_what_falls_and_what_stays(page, expected):
    assert extraction.main_text(page) == expected


def test_article_tags_are_not_needed(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("html").collect()]
    for page in pages:
        bare = (page or "").replace("<article>", "<div>").replace("</article>", "</div>")
        assert extraction.main_text(bare) == plain(page)


@pytest.mark.parametrize("page", [
    "<b>" * 170_000 + "</i>" * 120_000, '<p "' * 250_000, '<p "' * 250_000 + ">", "<p '" + '<a "x' * 200_000, "<b>" * 150_000 + "<p>x</p>" * 60_000, "<i><div>" + "<b>" * 150_000 + "</i>" * 120_000,
    '<p a="' * 160_000, "<p a=\"'>" * 120_000, "<script></script" * 60_000, "<a " * 300_000, "<b>" * 120_000 + "<header>x" * 70_000, "<table>" * 60_000 + "<td>" * 120_000,
])
def test_a_megabyte_of_odd_markup_takes_seconds(page):
    began = time.perf_counter()
    extraction.main_text(page)
    assert time.perf_counter() - began < 20

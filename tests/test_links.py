"""Links in prose."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from sparkveil.functions import detect, links

FOUND = [
    ("Visit https://example.com or http://test.org for more", ["https://example.com", "http://test.org"]),
    ("visit example.com today", ["example.com"]), ("Read https://example.com it's great", ["https://example.com"]), ("Check https://example.com/foo.", ["https://example.com/foo"]),
    ("(see http://a.com/b)", ["http://a.com/b"]), ("http://a.com/b_(c)", ["http://a.com/b_(c)"]), ("(http://a.com/b_(c))", ["http://a.com/b_(c)"]),
    ("[x](http://a.com),[y](http://b.com)", ["http://a.com", "http://b.com"]), ("<http://a.com/x>", ["http://a.com/x"]), ('"http://a.com/x"', ["http://a.com/x"]),
    ("http://a.com/x?y=1&z=2#top!", ["http://a.com/x?y=1&z=2#top"]), ("http://a.com?", ["http://a.com"]), ("http://a.com?q=1", ["http://a.com?q=1"]), ("http://a.com/...", ["http://a.com/"]),
    ("http://a.com/a...b", ["http://a.com/a...b"]), ("http://a.com/(((x)))y", ["http://a.com/(((x)))y"]), ("http://a.com/(x", ["http://a.com/(x"]), ("http://a.com/x)y", ["http://a.com/x"]),
    ("http://a.com/[1]{2}", ["http://a.com/[1]{2}"]), ("http://a.com/'q'", ["http://a.com/'q'"]), ("http://a.com/it's", ["http://a.com/it's"]), ("'http://a.com/x'", ["http://a.com/x"]),
    ("ftp://f.example.com/a.txt;", ["ftp://f.example.com/a.txt"]), ("ws://a.com/s wss://b.com/s", ["ws://a.com/s", "wss://b.com/s"]), ("HTTPS://A.COM/X", ["HTTPS://A.COM/X"]),
    ("file:///etc/passwd", ["file:///etc/passwd"]), ("git+ssh://git@host/x.git", ["git+ssh://git@host/x.git"]), ("http:///path", []), ("http://", []), ("foo:// bar", []),
    ("https://user:pw@a.com:8443/x", ["https://user:pw@a.com:8443/x"]), ("http://a.com:65535/", ["http://a.com:65535/"]), ("http://a.com:65536/", []), ("http://[::1]:80/x", ["http://[::1]:80/x"]),
    ("http://localhost:8080", ["http://localhost:8080"]), ("http://münchen.de/straße", ["http://münchen.de/straße"]), ("http://web.org/2010/http://a.com/", ["http://web.org/2010/http://a.com/"]),
    ("-http://a.com", ["http://a.com"]), ("http://a-b.com", ["http://a-b.com"]), ("http://a.com\nhttp://b.com", ["http://a.com", "http://b.com"]),
    ("www.example.com, github.io.", ["www.example.com", "github.io"]), ("map.contains foo.notatld 3.5.2 e.g. i.e.", []), ("a@example.com", []), ("example.com/path", []), ("example.com:80", []),
    ("x.co.uk", ["x.co.uk"]), ("EXAMPLE.COM", ["EXAMPLE.COM"]), ("end of it.So what", []), ("v1.2.com-x", []), ("", []),
]


def test_find(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(FOUND)], "i int, v string")
    got = {r.i: [s.matched_text for s in r.s] for r in df.select("i", detect.find(F.col("v"), "url").alias("s")).collect()}
    for i, (text, expected) in enumerate(FOUND):
        assert got[i] == expected, text


def test_gate_lets_links_through(spark):
    df = spark.createDataFrame([(t,) for t, found in FOUND if found], "v string")
    seen = detect.facts(F.col("v"))
    assert df.where(~detect.open_gate(seen, detect.BY_NAME["url"]) & (F.size(detect.find(F.col("v"), "url")) > 0)).count() == 0


@pytest.mark.parametrize(("value", "expected"), [
    ("http://example.com", True), ("https://example.com:8080/path", True), ("ftp://ftp.example.com/file.txt", True), ("ws://example.com/socket", True), (" example.com ", True), ("www.example.com", True),
    ("github.io", True), ("not-a-url", False), ("map.contains", False), ("foo.notatld", False), ("3.5.2", False), ("see http://a.com", False), ("com", False), (None, None),
])
def test_is_link(one, value, expected):
    assert one(links.is_link(F.col("v").cast("string")), v=value) is expected


def test_own_suffixes(one):
    v = F.col("v")
    assert one(links.known_host(v, ["co.uk", "zz"]), v="a.co.uk") is True and one(links.known_host(v, ["co.uk", "zz"]), v="a.org.uk") is False
    assert one(links.known_host(v, ["zz"]), v="zz") is False and one(links.known_host(v, [f"x{i}" for i in range(2000)]), v="a.X1999") is True


@pytest.mark.parametrize(("value", "expected"), [
    ("http://localhost:8080", True), ("http://127.0.0.1/test", True), ("http://[::1]:8080/", True), ("https://example.org/", True), ("https://myapp.test/", True), ("https://mysite.invalid", True),
    ("https://staging.myapp.com/", True), ("https://www.google.com", False), ("https://github.com/user/repo", False), ("https://my.testing.com", False),
])
def test_test_links(one, value, expected):
    assert one(links.is_test_link(F.col("v")), v=value) is expected


def test_long_texts_take_linear_time(spark):
    """Brackets, quotes, dots and labels without end."""
    n = 100_000
    rows = [("http://a.com/" + x * n,) for x in ("(", "(a", ")", "[(", "'", ".", "a.", "(x)", "((x)", "?x", "-")] + [("a." * n,), ("a-" * n,), ("a" * n,), ("http://" * n,), ("x@" * n,), ("https://a.com:1 " * n,)]
    df = spark.createDataFrame(rows, "v string").repartition(4)
    start = time.time()
    sizes = [r[0] for r in df.select(F.size(detect.find(F.col("v"), "url"))).collect()]
    assert max(sizes) == n and time.time() - start < 60

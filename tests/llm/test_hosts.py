from __future__ import annotations

import math

from pyspark.sql import functions as F

from sparkveil.llm import hosts

SCHEMA = "page_id long, url string, extra string"


def test_rules_and_parts(spark):
    rows = [
        (1, "http://WWW.example.com/en/x?q#f", None), (2, "https://a.example.com/en/1", None), (3, "http://example.com", None), (4, "http://x.net/fr/1", None), (5, "http://x.net/de/1", None),
        (6, "no scheme", None), (7, None, None), (8, "a://b://c/d", None), (8, "a://b://c/d", None), (9, "http://notexample.com/en/", None), (10, "HTTP://É.Net/es/\n?", None),
    ]
    pages = spark.createDataFrame(rows, SCHEMA)
    none = spark.createDataFrame([], "host string, good boolean")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in hosts.judge(pages, none).collect()}
    assert got == {
        (1, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (2, "a.example.com", "/en/1", "example.com/en/", "block"), (3, "example.com", "", None, "allow"),
        (4, "x.net", "/fr/1", "net/fr/", "block"), (5, "x.net", "/de/1", None, "allow"), (6, "", "", None, "allow"), (7, "", "", None, "allow"), (8, "b:", "//c/d", None, "allow"),
        (9, "notexample.com", "/en/", "com/", "allow"), (10, "É.net", "/es/\n", "net/es/", "block"),
    }
    assert hosts.judge(pages, none).count() == len(rows)
    assert hosts.judge(pages.limit(0), none).count() == 0


def test_levels(spark):
    df = spark.createDataFrame([("a.b.example.co.uk",), ("x.example.org",), ("localhost",), ("10.0.0.1",), ("",), ("a.de:80",)], "h string")
    assert [tuple(r) for r in df.select(*hosts.levels(df.h)).collect()] == [("example.co.uk", "co.uk"), ("example.org", "org"), ("localhost", "localhost"), ("10.0.0.1", ""), ("", ""), ("a.de", "de")]


def test_posterior_shrinks_towards_domain(spark):
    rows = [("bad.a.com", False)] * 40 + [("good.a.com", True)] * 40 + [("new.a.com", False)] + [("x.b.com", True)] * 50 + [("y.b.com", True)] * 50 + [("y.b.com", None)] * 9
    p = hosts.Params()
    got = {r.host: r for r in hosts.reputations(spark.createDataFrame(rows, "host string, good boolean"), p).collect()}
    assert (got["y.b.com"].n, got["y.b.com"].k) == (50, 50)
    assert got["bad.a.com"].posterior_mean < got["new.a.com"].posterior_mean < got["good.a.com"].posterior_mean < 1
    assert 0 < got["new.a.com"].posterior_mean < 0.6
    assert got["bad.a.com"].bad and not got["x.b.com"].bad and not got["good.a.com"].bad
    pages = spark.createDataFrame([(1, "http://bad.a.com/", ""), (2, "http://good.a.com/", "")], SCHEMA)
    verdicts = {r.page_id: r.verdict for r in hosts.judge(pages, spark.createDataFrame(rows, "host string, good boolean"), rules=()).collect()}
    assert verdicts == {1: "block", 2: "allow"}


def test_equals_plain_computation(spark):
    """The estimate against the formulas written out in Python."""
    counts = {"a.x.org": (30, 3), "b.x.org": (20, 19), "c.x.org": (10, 5), "a.y.org": (40, 35), "b.y.org": (5, 1), "a.z.net": (12, 11)}
    rows = [(h, i < k) for h, (n, k) in counts.items() for i in range(n)]
    p = hosts.Params()
    got = {r.host: r.posterior_mean for r in hosts.reputations(spark.createDataFrame(rows, "host string, good boolean"), p).collect()}

    def strength(groups):
        a = b = 0.0
        for children in groups:
            n, k = sum(x for x, _ in children), sum(y for _, y in children)
            if 0 < k < n and len(children) > 1:
                q = k / n
                a += (sum(y * y / x for x, y in children) - k * q) / (q * (1 - q)) - (len(children) - 1)
                b += n - sum(x * x for x, _ in children) / n - (len(children) - 1)
        if a <= 0 or b <= 0:
            return p.max_strength
        r = min(a / b, 0.999)
        return min(max(round((1 - r) / r, 6), p.min_strength), p.max_strength)

    def total(names):
        return sum(counts[h][0] for h in names), sum(counts[h][1] for h in names)

    domains = {"x.org": ["a.x.org", "b.x.org", "c.x.org"], "y.org": ["a.y.org", "b.y.org"], "z.net": ["a.z.net"]}
    suffixes = {"org": ["x.org", "y.org"], "net": ["z.net"]}
    sums = {d: total(hs) for d, hs in domains.items()}
    tops = {s: tuple(map(sum, zip(*[sums[d] for d in ds], strict=True))) for s, ds in suffixes.items()}
    n, k = map(sum, zip(*tops.values(), strict=True))
    s_suffix, s_domain = strength([list(tops.values())]), strength([[sums[d] for d in ds] for ds in suffixes.values()])
    s_host = strength([[counts[h] for h in hs] for hs in domains.values()])
    for s, ds in suffixes.items():
        ms = (tops[s][1] + s_suffix * k / n) / (tops[s][0] + s_suffix)
        for d in ds:
            md = (sums[d][1] + s_domain * ms) / (sums[d][0] + s_domain)
            for h in domains[d]:
                assert math.isclose(got[h], (counts[h][1] + s_host * md) / (counts[h][0] + s_host), abs_tol=2e-6)


def test_planted_bad_hosts_are_blocked(spark):
    """The pages of sf0.1 with forty bad hosts among theirs, from 8 to 60 labelled pages each and one good page in
    ten: all of their pages are blocked, whatever the domain, and none of the others."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    outcomes = hosts.page_outcomes(pages, spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    planted = [(f"spam{i}.{'example.com' if i % 2 else f'site{i}.org'}", j % 10 == 0) for i in range(40) for j in range(8 + i * 13 % 53)]
    more = spark.createDataFrame([(1_000_000 + i, f"https://{h}/x/{i}") for i, (h, _) in enumerate(planted)], "page_id long, url string")
    judged = hosts.judge(pages.union(more), outcomes.union(spark.createDataFrame(planted, "host string, good boolean")), rules=())
    got = {(r.planted, r.verdict): r.n for r in judged.selectExpr("page_id >= 1000000 AS planted", "verdict").groupBy("planted", "verdict").agg(F.count("*").alias("n")).collect()}
    assert got == {(True, "block"): len(planted), (False, "allow"): pages.count()}

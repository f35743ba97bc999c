"""Registered queries over rows that the given tables lack."""

from __future__ import annotations

from sparkveil.plans import queries


def run(spark, folder, name, table, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
    return sorted(map(tuple, queries.QUERIES[name](spark, str(folder)).collect()))


def test_scan_default_long_text(spark, tmp_path):
    rows = [(1, "word " * 3000 + "mail a@example.com"), (2, "word " * 3000), (3, None)]
    assert run(spark, tmp_path, "scan_default", "documents", rows, "doc_id long, text string") == [(1, "email,domain"), (2, ""), (3, None)]


def test_entropy_words_long_text(spark, tmp_path):
    secret = "aB3xK9mQ2wE7rT5yU8iO1pL4"
    rows = [(1, "word " * 30_000 + secret), (2, "word " * 30_000)]
    assert run(spark, tmp_path, "entropy_words", "documents", rows, "doc_id long, text string") == [(1, secret)]


def test_ssrf_flags_every_url(spark, tmp_path):
    rows = [
        (1, "https://example.com/"), (2, "http://169.254.169.254/latest"), (3, "http://localhost/"), (4, "http://2130706433/"), (5, "http://a.nip.io/"),
        (6, "file:///etc/passwd"), (7, "gopher://example.com/"), (8, "https://user:word@example.com/"), (9, None),
    ]
    got = dict(run(spark, tmp_path, "ssrf_flags", "pages", rows, "page_id long, url string"))
    assert sorted(got) == list(range(1, 10))
    has = {2: "cloud_metadata", 3: "internal_host", 4: "encoded_ip", 5: "dns_rebinding", 6: "dangerous_scheme", 7: "dangerous_scheme", 8: "credentials"}
    assert all(name in got[i].split(",") for i, name in has.items())
    assert got[1] == got[9] == ""


def test_entropy_words_equal_plain(spark, sf_dir):
    """The words of every document, by counting characters."""
    import math
    import re

    def high(w):
        bits = -sum(w.count(c) / len(w) * math.log2(w.count(c) / len(w)) for c in set(w)) - (1.2 / math.log2(len(w)) if w.isdigit() else 0)
        odd = re.search(r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$|^v?[0-9]+(?:\.[0-9]+)+|^#[0-9a-fA-F]{3,8}$|^(.)\1+$", w)
        return not odd and bits >= (3.0 if re.fullmatch("[0-9a-fA-F]+", w) else 4.5)

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    expected = [(r.doc_id, w) for r in docs for w in re.split(r"[\s\"'`,;:=(){}\[\]<>|&]+", r.text or "", flags=re.ASCII) if len(w) >= 20 and high(w)]
    assert sorted(map(tuple, queries.QUERIES["entropy_words"](spark, folder).collect())) == sorted(expected)


def test_format_limits_equal_plain(spark, sf_dir):
    """What the made texts expand to, by their keys: each alias three nodes, the outer entity itself and its references."""
    got = {r.c_custkey: r for r in queries.QUERIES["format_limits"](spark, sf_dir).collect()}
    assert len(got) == spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    for key, r in got.items():
        assert ("expansions" in r.xml) == (key % 10 == 4 and 1 + key % 7 > 3), key
        assert ("expansions" in r.yaml) == (key % 10 == 6 and key % 17 * 3 > 3), key
        assert ("depth" in r.json) == (key % 10 == 0 and 2 * (key % 71) > 20), key


def test_made_texts_are_spread(spark, tmp_path):
    """The texts made for the customers of one file are scanned on all cores."""
    spark.range(1, 50).selectExpr("id AS c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, "x")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    made = queries._texts(spark, str(tmp_path), queries._PAIR_TEXTS)
    assert made.rdd.getNumPartitions() >= 8 * spark.sparkContext.defaultParallelism
    assert made.count() == 50

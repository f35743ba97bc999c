from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from sparkveil.functions import crypto_address as ca
from sparkveil.operators import lexicon


@pytest.mark.parametrize(("value", "good"), [
    ("1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN2", True), ("1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN3", False), ("3J98t1WpEZ73CNmQviecrnyiWrnqRhWNLy", True), ("bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4", True),
    ("bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t5", False), ("0x5aAeb6053F3E94C9b9A09f33669435E7Ef1BeAed", True), ("0x5aAeb6053F3E94C9b9A09f33669435E7Ef1BeAeD", False),
    ("0x5aaeb6053f3e94c9b9a09f33669435e7ef1beaed", True), ("0x12", False), ("", False),
])
def test_addresses(value, good):
    assert ca.is_valid(value) is good


def test_keccak():
    assert ca.keccak256(b"").hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert ca.keccak256(b"x" * 135) != ca.keccak256(b"x" * 136) != hashlib.sha3_256(b"x" * 136).digest()


def test_address_column(one):
    assert one(ca.crypto_address(F.col("v")), v="1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN2") is True


def test_hits(spark):
    docs = spark.createDataFrame([(1, "From New York, then Paris by a turkey farm in Turkey."), (2, "the polish was French"), (3, None), (4, "")], "doc_id long, text string")
    got = sorted((r.doc_id, r.position, r.phrase, r.kind) for r in lexicon.hits(docs, lexicon.table(spark)).collect())
    assert got == [(1, 1, "new york", "city"), (1, 4, "paris", "city"), (1, 10, "turkey", "country"), (2, 3, "french", "nationality")]


def test_long_phrases_and_overlaps(spark):
    docs = spark.createDataFrame([(1, "Saint Vincent  and-the GRENADINES; United States of America"), (2, "vincent and the"), (None, "Ünited kingdom, united Kingdom")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.position, r.phrase) for r in lexicon.hits(docs, lexicon.table(spark)).collect()), key=str)
    assert got == [(1, 0, "saint vincent and the grenadines"), (1, 5, "united states of america"), (1, 5, "united states"), (None, 2, "united kingdom")]


def test_large_lexicon_in_parts_equals_brute_force(spark):
    """500,000 phrases of one to six words of a small vocabulary, so that they nest and overlap."""
    import random

    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "naïve", "ß"]
    phrases = {" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 7))) for _ in range(800_000)}
    assert len(phrases) > 500_000
    lines = sorted(phrases)
    table = spark.createDataFrame([("\n".join(lines),)], "t string").selectExpr("explode(split(t, '\n')) AS phrase", "'k' AS kind", "'medium' AS confidence")
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 200))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = []
    for i, t in enumerate(texts):
        ws = t.split()
        want += [(i, a, p) for a in range(len(ws)) for n in range(1, 7) if a + n <= len(ws) and (p := " ".join(ws[a : a + n])) in phrases]
    got = lexicon.hits(docs, table)
    assert "Union" in got._jdf.queryExecution().toString()  # 3 parts of 200,000 at most
    assert sorted((r.doc_id, r.position, r.phrase) for r in got.collect()) == sorted(want)


def test_no_lexicon_and_no_texts(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lexicon.hits(docs, lexicon.table(spark, {"x": ("--",)})).collect() == []
    assert lexicon.hits(docs.limit(0), lexicon.table(spark)).collect() == []

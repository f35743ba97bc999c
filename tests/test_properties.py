"""Properties: lengths kept, round trips, independence of order and partitioning."""

from __future__ import annotations

import math
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkveil.functions import entropy, masking, threats, tokens
from sparkveil.operators import anonymize as anon

SETTINGS = {"max_examples": 10, "deadline": None, "suppress_health_check": [HealthCheck.function_scoped_fixture]}
WORDS = st.lists(st.text(max_size=30), min_size=1, max_size=10)


@settings(**SETTINGS)
@given(WORDS)
def test_masks_keep_the_length(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    v = F.col("v")
    masks = [masking.show_first(v, 3), masking.show_last(v, 3), masking.mask_all(v), masking.mask_middle(v), masking.keep_format(v), masking.mask_chars(v, 5)]
    assert all(all(n == r[0] for n in r[1:]) for r in df.select(F.length(v), *[F.length(m) for m in masks]).collect())


@settings(**SETTINGS)
@given(WORDS)
def test_entropy_equals_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for r in df.select("v", entropy.shannon(F.col("v")).alias("h")).collect():
        n = len(r.v)
        expected = -sum(c / n * math.log2(c / n) for c in Counter(r.v).values()) if n else 0.0
        assert abs(r.h - expected) < 1e-9


@settings(**SETTINGS)
@given(WORDS)
def test_ciphers_round_trip(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    kind = F.lit("k")
    for r in df.select("v", *[tokens.decrypt(tokens.encrypt(F.col("v"), "key", kind, d), "key", kind).alias(f"d{d}") for d in (True, False)]).collect():
        assert r.v == r.dTrue == r.dFalse


@settings(**SETTINGS)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 15), st.integers(0, 3), st.sampled_from("ABC")), max_size=8), st.sampled_from(anon.STRATEGIES))
def test_resolved_spans_never_overlap(spark, spans, strategy):
    text = "x" * 60
    rows = [{"entity_type": k, "start": a, "end": a + n, "score": s / 3} for a, n, s, k in spans]
    schema = "spans array<struct<entity_type:string,start:int,end:int,score:double>>"
    both = [spark.createDataFrame([(r,)], schema).select(anon.resolve(F.col("spans"), strategy).alias("r"), anon.anonymize(F.lit(text), F.col("spans"), {}, strategy).alias("a")).first() for r in (rows, rows[::-1])]
    found = [(s.start, s.end) for s in both[0].r]
    assert found == sorted(found) and all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))
    items = both[0].a["items"]
    assert all(both[0].a.text[i.start : i.end] == i.text for i in items)
    assert len(both[0].a.text) == 60 - sum(b - a for a, b in found) + sum(len(i.text) for i in items)
    if strategy != "none":
        assert [(s.start, s.end) for s in both[1].r] == found


@settings(**SETTINGS)
@given(WORDS)
def test_literals_read_back(spark, values):
    for v in values:
        if "\x00" in v or "\\" in v:
            continue
        literal = spark.createDataFrame([(v,)], "v string").select(threats.sql_literal(F.col("v"))).first()[0]
        assert literal[1:-1].replace("''", "'") == v

"""Running state, offsets and conflicts: equal to plain Python, and in time that follows the number of spans."""

from __future__ import annotations

import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkveil.functions import arrays, detect
from sparkveil.operators import anonymize as anon
from sparkveil.operators import spans as span_tables
from sparkveil.operators.sweep import BLOCK, Gaps, resolved
from sparkveil.schemas import DETECTION


def plain(spans, trim):
    """The definition: best first, each against all that stay."""
    kept = []
    for kind, s, e, score in sorted(spans, key=lambda x: (-x[3], x[1] - x[2], x[1], x[0])):
        if not trim:
            if not any(a < e and s < b for _, a, b, _ in kept):
                kept.append((kind, s, e, score))
            continue
        free, at = [], s
        for _, a, b, _ in sorted((k for k in kept if k[1] < e and s < k[2]), key=lambda k: k[1]):
            free.append((at, min(a, e)))
            at = max(at, b)
        free = [(a, b) for a, b in [*free, (at, e)] if a < b]
        if free:
            kept.append((kind, *max(free, key=lambda f: (f[1] - f[0], -f[0])), score))
    return sorted(kept, key=lambda k: k[1])


def listed(rows):
    kind = pa.list_(pa.struct([("entity_type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    return pa.array([None if r is None else [dict(zip(DETECTION.names, s, strict=True)) for s in r] for r in rows], kind)


@pytest.mark.parametrize("trim", [False, True])
def test_sweep_equals_definition(trim):
    rng = random.Random(4)
    rows = [None, [], [("A", 3, 3, 1.0)], [("A", 5, 2, 1.0), ("B", 0, 1, 0.5)]]
    for _ in range(300):
        n, width, longest = rng.randrange(1, 60), rng.randrange(5, 200), rng.randrange(1, 60)
        rows.append([(rng.choice("ABC"), s := rng.randrange(width), s + 1 + rng.randrange(longest), rng.randrange(4) / 4) for _ in range(n)])
    out = resolved(listed(rows), trim)
    assert out.to_pylist()[:4] == [None, [], [], [{"entity_type": "B", "start": 0, "end": 1, "score": 0.5}]]
    for row, got in zip(rows[4:], out.to_pylist()[4:], strict=True):
        assert [tuple(g.values()) for g in got] == plain(row, trim)


@pytest.mark.parametrize("trim", [False, True])
def test_sweep_of_one_large_group(trim):
    """Thousands of spans that hang together, so that the gaps fill several blocks."""
    rng = random.Random(5)
    row = [("A", s := 7 * rng.randrange(3000), s + 1 + rng.randrange(5), 0.9) for _ in range(3000)]
    row += [("B", s := rng.randrange(20_000), s + 1 + rng.randrange(2000), rng.random() * 0.8) for _ in range(400)] + [("C", 0, 21_000, 0.1)]
    assert [tuple(g.values()) for g in resolved(listed([row]), trim).to_pylist()[0]] == plain(row, trim)


def test_gaps_of_many_blocks():
    rng, width = random.Random(6), 20 * BLOCK
    gaps, taken = Gaps(0, width), [False] * width
    for s in rng.sample(range(0, width, 2), width // 2 - 200):
        gaps.take(s, s + 1)
        taken[s] = True
    assert len(gaps.starts) > 4 and [s for b in gaps.starts for s in b] == sorted(s for b in gaps.starts for s in b)
    assert gaps.most == [max(b) for b in gaps.sizes] and gaps.first == [b[0] for b in gaps.starts]
    for _ in range(300):
        a = rng.randrange(width - 1)
        b = rng.randrange(a + 1, width + 1)
        runs, at = [], a
        for i in range(a, b + 1):
            if i == b or taken[i]:
                runs.append((i - at, -at))
                at = i + 1
        size, back = max(runs)
        assert gaps.longest(a, b) == ((-back, size - back) if size else None)
        assert gaps.free(a, b) == (not any(taken[a:b]))


def test_scan_equals_plain(spark):
    rng = random.Random(7)
    rows = [[rng.randrange(-5, 9) for _ in range(n)] for n in (0, 1, 2, 63, 64, 65, 4095, 4096, 4097, 9000)]
    df = spark.createDataFrame([(r,) for r in [*rows, None]], "a array<int>")
    step = lambda total, x: (total + x, F.when(x > 0, total + x))
    for row, got in zip([*rows, None], df.select(arrays.scan(F.col("a"), F.lit(0), step, "int").alias("o")).collect(), strict=True):
        total, want = 0, []
        for x in row or []:
            total += x
            want += [total] if x > 0 else []
        assert got.o == (None if row is None else want)


def test_lines_and_bytes_of_long_texts(spark):
    rng = random.Random(8)
    text = "".join(rng.choice(["é", "a", "\n", "mail@x.org", " ", "𝒳"]) for _ in range(8000))
    df = spark.createDataFrame([(1, text), (2, ""), (3, "a@b.co"), (4, None)], "doc_id long, text string")
    rows = span_tables.spans_table(df, ["email"], lines=True).collect()
    assert {r.doc_id for r in rows} == {1, 3}
    for r in rows:
        t = text if r.doc_id == 1 else "a@b.co"
        assert (r.start_line, r.end_line) == (t[: r.start].count("\n"), t[: r.end].count("\n"))
    found = df.where("doc_id = 1").select(detect.byte_spans(F.col("text"), detect.find(F.col("text"), "email")).alias("s")).first().s
    assert len(found) > 100 and all((s.byte_start, s.byte_end) == (len(text[: s.start].encode()), len(text[: s.end].encode())) for s in found)


def seconds(df):
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def test_finding_takes_time_in_proportion(spark):
    took = []
    for n in (20_000, 20_000, 80_000):
        df = spark.createDataFrame([("a@bc.co " * n,)], "t string")
        took.append(seconds(df.select(detect.find(F.col("t"), "email"), detect.find(F.col("t"), "domain"))))
    assert took[2] < 10 * max(took[1], 0.5)


@pytest.mark.parametrize("strategy", anon.STRATEGIES)
def test_200_000_spans_in_one_text(spark, strategy):
    n = 200_000
    df = spark.range(1).select(F.repeat(F.lit("abcde"), F.lit(n + 2)).alias("t"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.alias("i"))).alias("n"))
    spans = F.transform("n", lambda x: F.struct(
        F.lit("A").alias("entity_type"), (x["i"] * 5).cast("int").alias("start"), (x["i"] * 5 + 3 + x["i"] % 5).cast("int").alias("end"), ((x["i"].cast("long") * 7919) % 1000 / 1000).alias("score"),
    ))
    out = df.select(anon.anonymize(F.col("t"), spans, {"DEFAULT": anon.Operator("redact")}, strategy).alias("a")).select(F.size("a.items").alias("n"), F.length("a.text").alias("left"))
    began = time.perf_counter()
    got = out.first()
    assert time.perf_counter() - began < 60 and got.n > n // 2 and got.left < 5 * n


def test_expressions_and_sweep_agree(spark):
    """Spans from `find` under both forms, and random overlaps, against the definition."""
    rng = random.Random(9)
    rows = [(i, "x" * 120, [("T", s := rng.randrange(110), s + 1 + rng.randrange(30), rng.randrange(4) / 4) for _ in range(rng.randrange(0, 30))]) for i in range(60)]
    df = spark.createDataFrame([*rows, (99, "ab", None), (98, None, [("T", 0, 1, 0.5)])], f"i int, t string, d {T.ArrayType(DETECTION).simpleString()}")
    for strategy in ("keep_best", "trim"):
        ops = {"DEFAULT": anon.Operator("redact")}
        forms = [anon.anonymize_frame(df, "t", "d", ops, strategy, "a", swept) for swept in (False, True)]
        one, two = ({r.i: r.a for r in f.select("i", "a").collect()} for f in forms)
        assert one == two and one[98] is None and one[99].text == "ab"
        got = {r.i: [tuple(x) for x in r.s] for r in df.where("i < 98").select("i", anon.resolve(F.col("d"), strategy, F.length("t")).alias("s")).collect()}
        assert all(got[i] == plain([x for x in d if x[2] <= 120], strategy == "trim") for i, _, d in rows)
    found = F.transform(detect.find(F.col("t"), "email"), lambda s: F.struct(s["identifier_type"].alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), F.lit(1.0).alias("score")))
    mail = spark.createDataFrame([("x a@b.co y",)], "t string")
    assert mail.select(anon.anonymize(F.col("t"), found).alias("a")).first().a.text == "x <email> y"
    assert anon.anonymize_frame(mail.select("t", found.alias("d")), "t", "d", swept=True).first().anonymized.text == "x <email> y"


@pytest.mark.parametrize("strategy", anon.STRATEGIES)
def test_text_alone_equals_the_text_with_items(spark, strategy):
    """Without items, on both sides of the lengths up to which arrays and texts are taken in one part."""
    rng = random.Random(9)
    rows = [(None, []), ("", []), ("ab", None)]
    for n in (0, 1, arrays.CHUNK, arrays.CHUNK + 1):
        for size in (arrays.PIECE - 1, arrays.PIECE, arrays.PIECE + 1):
            rows.append(("é\n" * (size // 2) + "x" * (size % 2), [("T1" if i % 2 else "T2", s := rng.randrange(size - 9), s + 1 + rng.randrange(9), rng.randrange(3) / 4) for i in range(n)]))
    df = spark.createDataFrame(rows, T.StructType([T.StructField("t", T.StringType()), T.StructField("d", T.ArrayType(DETECTION))]))
    ops = {"T1": anon.Operator("redact")}
    both = df.select("t", anon.resolve(F.col("d"), strategy, F.length("t")).alias("s"), anon.anonymize(F.col("t"), F.col("d"), ops, strategy).alias("a"), anon.anonymize(F.col("t"), F.col("d"), ops, strategy, items=False).alias("b")).collect()
    for r in both:
        want, at = "", 0
        for kind, start, end, _ in r.s or []:
            want, at = want + r.t[at:start] + ("" if kind == "T1" else "<T2>"), end
        assert r.b == (None if r.t is None else want + r.t[at:]) and (r.a is None or r.a.text == r.b)


def test_spans_of_long_patterns(spark):
    """The pattern isn't compiled anew for each text."""
    df = spark.range(12000).selectExpr("concat('see https://a.example.com/x', id, ' or b', id, '.com') AS t").coalesce(1).cache()
    df.count()
    began = time.perf_counter()
    got = df.select(F.expr("t"), detect.find(F.col("t"), "url").alias("s")).collect()
    assert time.perf_counter() - began < 24
    assert all([r.t[s.start : s.end] for s in r.s] == [s.matched_text for s in r.s] == [r.t.split()[1], r.t.split()[3]] for r in got)


def test_spans_beside_the_mark(spark):
    """A text that holds what stands for matches."""
    rows = [("\u0001a1b\u000122\u0001",), ("\u00013",), ("4\u0001",), ("\u0001",), ("5x6",), ("",)]
    got = {r.t: [(s.start, s.end, s.matched_text) for s in r.s] for r in spark.createDataFrame(rows, "t string").select("t", detect.raw_spans(F.col("t"), "[0-9]+").alias("s")).collect()}
    assert got == {t: [(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+", t)] for (t,) in rows}

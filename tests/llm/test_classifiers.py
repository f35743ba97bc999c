from __future__ import annotations

import math
import random
import zlib
from itertools import groupby

import numpy as np
import pytest

from sparkveil.llm import quality, toxicity
from sparkveil.llm.learning import training_sample
from sparkveil.llm.words import FINAL, FIRST, SECOND, SKIPPED

DOCS, LABELS = "doc_id long, text string, label string, score int", "doc_id long, toxic int, quality int"


def corpus(n=600, seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        body = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        toxic, poor = i % 5 == 0, i % 7 == 0
        if toxic:
            body[rng.randrange(len(body))] = "Insult!"
        if poor:
            body = [w + "***" for w in body]
        docs.append((i, " ".join(body), "x", 1))
        labels.append((i, int(toxic), int(not poor)))
    return docs, labels


def edges():
    return [(-1, None, None, None), (-2, "", None, None), (-3, "Insult! " * 50_000, None, None), (None, "w1 w2", None, None), (-4, "w1 w2", None, None), (-4, "w1 w2", None, None), (-5, "\ud83d\ude00 \x00 İ", None, None)]


@pytest.fixture(scope="module")
def frames(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs + edges(), DOCS), spark.createDataFrame([*labels, (1, 1, 0), (None, 1, 1), (2, None, None)], LABELS)


def test_toxicity(frames):
    docs, labels = frames
    rows = toxicity.toxicity(docs, labels, toxicity.Params(l1=0.5)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id >= 0]
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in held]) > 0.95
    by = {r.doc_id: r.score for r in rows}
    assert by[-1] == by[-2] and by[-3] > 0.5


def test_toxicity_without_rows(frames):
    docs, labels = frames
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    kept = toxicity.drop_toxic(docs, labels, toxicity.Params(l1=0.5))
    assert kept.columns == docs.columns and kept.where("text like 'Insult! Insult!%'").count() == 0


def test_sample_is_bounded_and_ignores_held_out(frames):
    docs, labels = frames
    sample = training_sample(docs, labels, "toxic", 50).collect()
    assert len(sample) == 50 and all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in sample)


def test_ftrl_is_sparse():
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for i in range(800):
        y = i % 2
        rows.append(np.unique(np.concatenate([[7 if y else 8], rng.integers(100, 5000, 10)])))
        labels.append(y)
    m = toxicity.ftrl(rows, np.array(labels, float), toxicity.Params(bits=13, l1=3.0))
    dense = m.dense()
    assert dense[7] > 0 > dense[8] and len(m.index) < 600


def test_quality(frames):
    docs, labels = frames
    rows = quality.quality(docs, labels).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id >= 0]
    assert np.mean([r.kept == (r.doc_id % 7 != 0) for r in held]) > 0.97
    kept = quality.drop_low_quality(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert {r.kept for r in quality.quality(docs, labels.limit(0)).collect()} == {True}
    assert quality.quality(docs.limit(0), labels).count() == 0


def test_ordinal_grades():
    """Four grades: thresholds stay ordered and the expected grade follows the true one."""
    rng = np.random.default_rng(1)
    rows, grades = [], []
    for _ in range(3000):
        g = int(rng.integers(4))
        level = np.clip(rng.normal(g, 0.3), 0, 3) / 3
        rows.append((np.array([1, 2, int(rng.integers(10, 60))]), np.array([level, 1 - level, 0.1])))
        grades.append(2 * g)
    p = quality.Params(bits=8, passes=6, min_grade=4)
    m = quality.fit(rows, np.array(grades), p)
    assert m.grades == (0, 2, 4, 6) and (np.diff(m.thresholds) > 0).all()
    dense = m.dense()
    tails = quality.probabilities(np.array([dense[i] @ x for i, x in rows]), m)
    assert ((0 <= tails) & (tails <= 1)).all() and (np.diff(tails, axis=1) <= 0).all()
    expected = m.grades[0] + tails @ np.diff(m.grades)
    assert np.corrcoef(expected, grades)[0, 1] > 0.9
    assert np.mean((tails[:, 1] >= 0.5) == (np.array(grades) >= 4)) > 0.9


def test_weights_follow_the_grades():
    """A feature of the top grade alone rises, one of the lowest alone falls."""
    rows = [(np.array([3 + g]), np.array([1.0])) for g in (0, 1, 2)] * 30
    m = quality.fit(rows, np.array([0, 1, 2] * 30), quality.Params(bits=4, passes=3))
    dense = m.dense()
    assert dense[3] < dense[4] < dense[5] and dense[3] < 0 < dense[5]


# ---- the operators again in plain Python: loops over words, dictionaries for weights

ALL = (1 << 64) - 1


def plain_words(text, lower=True):
    """Hashes of the words without punctuation."""
    raw = (text or "").lower().encode("utf-8", "replace") if lower else (text or "").encode("utf-8", "replace")
    return [zlib.crc32(w) for w in bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in raw).split()]


def plain_mix(x, bits):
    return (((x ^ (x >> 31)) * int(FINAL)) & ALL) >> (64 - bits)


def plain_hash(h, bits):
    return plain_mix((h * int(FIRST)) & ALL, bits)


def plain_grams(text, bits):
    h, out = plain_words(text), set()
    for i, x in enumerate(h):
        out.add(plain_hash(x, bits))
        if i + 1 < len(h):
            out.add(plain_mix((x * int(SECOND) + h[i + 1] * int(FIRST)) & ALL, bits))
        if i + 2 < len(h):
            out.add(plain_mix((x * int(SKIPPED) + h[i + 2] * int(FIRST)) & ALL, bits))
    return sorted(out)


def plain_ftrl(rows, p):
    """FTRL-proximal, a coordinate at a time."""
    z, n = {}, {}
    rate = min(max(sum(y for _, y in rows) / len(rows), 1e-3), 1 - 1e-3)
    bias, bias_n = math.log(rate / (1 - rate)), 1.0

    def weight(i):
        if abs(z.get(i, 0.0)) <= p.l1:
            return 0.0
        return -(z[i] - math.copysign(p.l1, z[i])) / ((p.beta + math.sqrt(n[i])) / p.alpha + p.l2)

    for _ in range(p.passes):
        for features, y in rows:
            w = [weight(i) for i in features]
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w) + bias)))) - y
            for i, old in zip(features, w, strict=True):
                before = n.get(i, 0.0)
                n[i] = before + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(before)) / p.alpha * old
            bias_n += g * g
            bias -= p.alpha * g / (p.beta + math.sqrt(bias_n))
    return {i: weight(i) for i in z}, bias


def labelled(spark, label):
    """(documents by id, [(text, label)] to learn from in order, ids) of sf0.01."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    marks = {r.doc_id: r[label] for r in labels.where(f"{label} is not null").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    order = [r.doc_id for r in docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(3))).collect()]
    learn = [i for i in order if i in marks and zlib.crc32(str(i).encode()) % 5]
    return docs, labels, texts, [(texts[i], marks[i]) for i in learn]


def test_toxicity_query_equals_plain(spark):
    docs, labels, texts, learn = labelled(spark, "toxic")
    p = toxicity.Params()
    weights, bias = plain_ftrl([(plain_grams(t, p.bits), y) for t, y in learn], p)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        score = 1 / (1 + math.exp(-max(-35, min(35, bias + sum(weights.get(f, 0.0) for f in plain_grams(text, p.bits))))))
        assert abs(got[i].score - score) < 1e-4 and (got[i].predicted == int(score >= 0.5) or abs(score - 0.5) < 1e-4)


def plain_shape(word):
    kind = lambda c: "a" if c.islower() else "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
    return "".join(k if k in "aA9" or len(list(run)) == 1 else 2 * k for k, run in groupby(word.decode("utf-8", "replace"), kind)).encode()


def plain_features(text, bits):
    """{feature: square root of its share of the words}."""
    words = (text or "").encode("utf-8", "replace").split()
    out = {}
    add = lambda f: out.__setitem__(f, out.get(f, 0) + 1)
    bare = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
    shapes = [zlib.crc32(plain_shape(w)) for w in words]
    for i, w in enumerate(words):
        add(plain_hash(zlib.crc32(w.lower().translate(bare).strip()), bits))
        add(plain_mix((shapes[i] * int(SECOND)) & ALL, bits))
        if i + 1 < len(words):
            add(plain_mix((shapes[i] * int(FIRST) + shapes[i + 1] * int(SECOND) + 1) & ALL, bits))
            if words[i + 1] == w:
                add(0)
        if w in words[:i]:
            add(1)
    return {f: math.sqrt(n / len(words)) for f, n in out.items()}


def plain_ordinal(rows, p):
    """The cumulative link's likelihood by AdaGrad, for two grades: one threshold."""
    sigmoid = lambda x: 1 / (1 + math.exp(-max(-35, min(35, x))))
    low = sum(y == 0 for _, y in rows) / len(rows)
    low = min(max(low, 1e-3), 1 - 1e-3)
    w, n, t, t_n = {}, {}, math.log(low / (1 - low)), 1.0
    for _ in range(p.passes):
        for x, y in rows:
            below = sigmoid(t - sum(w.get(f, 0.0) * v for f, v in x.items()))
            slope = 1 - below if y == 0 else -below
            for f, v in x.items():
                g = slope * v + p.decay * w.get(f, 0.0)
                n[f] = n.get(f, 1e-2) + g * g
                w[f] = w.get(f, 0.0) - p.rate * g / math.sqrt(n[f])
            t_n += slope * slope
            t -= 0.1 * -slope / math.sqrt(t_n)
    return w, t


def test_quality_query_equals_plain(spark):
    docs, labels, texts, learn = labelled(spark, "quality")
    p = quality.Params()
    w, t = plain_ordinal([(plain_features(x, p.bits), y) for x, y in learn], p)
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        s = sum(w.get(f, 0.0) * v for f, v in plain_features(text, p.bits).items())
        tail = 1 - 1 / (1 + math.exp(-max(-35, min(35, t - s))))
        assert abs(got[i].tail - tail) < 1e-3 and abs(got[i].expected_grade - tail) < 1e-3 and (got[i].kept == (tail >= 0.5) or abs(tail - 0.5) < 1e-3)


def test_shapes_are_of_whole_words():
    for word in ("a1" * 40, "a1" * 400, "Ab--9" * 30, "\u4f60\u597d\uff0c" * 50, "x" * 1000, "\U0001f600!" * 40, "", "Hello!!"):
        assert quality.shape(word.encode()) == plain_shape(word.encode())
    assert quality.shape(b"a1" * 40) != quality.shape(b"a1" * 400)


def test_awkward_names(frames):
    docs, labels = frames
    odd = docs.toDF("doc_id", "text", "a.b", "c1")
    for kept in (toxicity.drop_toxic(odd, labels, toxicity.Params(l1=0.5)), quality.drop_low_quality(odd, labels)):
        assert kept.columns == odd.columns and 0 < kept.count() <= odd.count()

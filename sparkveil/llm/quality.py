"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

P(grade <= k) = sigmoid(t_k - w.x) with one weight vector and ordered thresholds t_0 < t_1 < ...
The features are hashed from the whole text: words, word shapes, pairs of shapes and marks of
repetition, each weighted by the square root of its share of the text's words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, positional, sliced, texts_of
from .learning import held_out, training_sample
from .toxicity import sigmoid
from .words import FIRST, PUNCTUATION, SECOND, encoded, owners, scattered


@dataclass(frozen=True)
class Params:
    """bits: features are hashed into 2**bits; sample_rows: bound of the training sample; rate, decay:
    of the AdaGrad steps and the L2 term; passes: over the sample; min_grade: lowest grade to select;
    min_tail: least P(grade >= min_grade) to select."""

    bits: int = 18
    sample_rows: int = 12_000
    rate: float = 0.5
    decay: float = 1e-6
    passes: int = 4
    min_grade: int = 1
    min_tail: float = 0.5


@dataclass(frozen=True)
class Model:
    """grades: the ratings in order; thresholds: one less than grades, increasing."""

    bits: int
    grades: tuple[int, ...]
    thresholds: np.ndarray
    index: np.ndarray
    weight: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits)
        out[self.index] = self.weight
        return out


def _kind(c: str) -> str:
    return "a" if c.islower() else "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c


def shape(word: bytes) -> bytes:
    """Runs of lower-case, upper-case letters and digits as a, A and 9; a run of any other character
    as it, doubled if it is longer. The whole word counts, however long."""
    text = word.decode("utf-8", "replace")
    if len(text) <= 64:
        runs = ((k, sum(1 for _ in run)) for k, run in groupby(text, _kind))
    else:
        chars, index = np.unique(np.frombuffer(text.encode("utf-32-le"), "<u4"), return_inverse=True)
        kinds = [_kind(chr(c)) for c in chars]
        codes = np.array([ord(k) for k in kinds])[index]
        starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        runs = zip(map(chr, codes[starts].tolist()), np.diff([*starts, len(codes)]).tolist(), strict=True)
    return "".join(k if k in "aA9" or n == 1 else 2 * k for k, n in runs).encode()


def features(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text position, feature, value), sorted by text and feature; a text without words has none."""
    index, words, bounds = encoded([t.encode("utf-8", "replace") for t in texts])
    if not len(index):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    doc = owners(bounds)
    plain = np.fromiter((zlib.crc32(w.lower().translate(PUNCTUATION).strip()) for w in words), dtype=np.uint64, count=len(words))[index]
    shapes = np.fromiter((zlib.crc32(shape(w)) for w in words), dtype=np.uint64, count=len(words))[index]
    same = np.flatnonzero(doc[1:] == doc[:-1])
    again = same[index[same] == index[same + 1]]
    first = np.unique((doc << 32) | index, return_index=True)[1]
    old = np.ones(len(index), dtype=bool)
    old[first] = False
    with np.errstate(over="ignore"):
        parts = [
            (doc, scattered(plain * FIRST, bits)),
            (doc, scattered(shapes * SECOND, bits)),
            (doc[same], scattered(shapes[same] * FIRST + shapes[same + 1] * SECOND + np.uint64(1), bits)),
            (doc[again], np.zeros(len(again), np.int64)),
            (doc[old], np.ones(int(old.sum()), np.int64)),
        ]
    keys, counts = np.unique((np.concatenate([d for d, _ in parts]) << bits) | np.concatenate([f for _, f in parts]), return_counts=True)
    owner = keys >> bits
    return owner, keys & ((1 << bits) - 1), np.sqrt(counts / np.diff(bounds)[owner])


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, p: Params) -> Model:
    """AdaGrad on the likelihood of the cumulative link. The thresholds are the first one plus positive
    steps, so they stay ordered. One grade alone needs no weights."""
    names, y = np.unique(grades, return_inverse=True)
    k = len(names)
    if k < 2:
        return Model(p.bits, tuple(int(g) for g in names), np.zeros(0), np.zeros(0, np.int64), np.zeros(0))
    w, n = np.zeros(1 << p.bits), np.full(1 << p.bits, 1e-2)
    share = np.clip(np.cumsum(np.bincount(y, minlength=k))[:-1] / len(y), 1e-3, 1 - 1e-3)
    t = np.log(share / (1 - share))
    raw = np.concatenate([t[:1], np.log(np.maximum(np.diff(t), 1e-2))])
    raw_n = np.ones(k - 1)
    for _ in range(p.passes):
        for (i, x), c in zip(rows, y.tolist(), strict=True):
            t = np.concatenate([raw[:1], raw[0] + np.cumsum(np.exp(raw[1:]))])
            s = float(w[i] @ x)
            upper = float(sigmoid(t[c] - s)) if c < k - 1 else 1.0
            lower = float(sigmoid(t[c - 1] - s)) if c else 0.0
            mass = max(upper - lower, 1e-9)
            du, dl = upper * (1 - upper) / mass, lower * (1 - lower) / mass
            g = (du - dl) * x + p.decay * w[i]  # of the negative log likelihood
            n[i] += g * g
            w[i] -= p.rate * g / np.sqrt(n[i])
            dt = np.zeros(k - 1)
            if c < k - 1:
                dt[c] -= du
            if c:
                dt[c - 1] += dl
            draw = np.concatenate([[dt.sum()], np.cumsum(dt[:0:-1])[::-1] * np.exp(raw[1:])])
            raw_n += draw * draw
            raw -= 0.1 * draw / np.sqrt(raw_n)
    t = np.concatenate([raw[:1], raw[0] + np.cumsum(np.exp(raw[1:]))])
    used = np.flatnonzero(w)
    return Model(p.bits, tuple(int(g) for g in names), t, used, w[used])


def probabilities(s: np.ndarray, m: Model) -> np.ndarray:
    """P(grade >= g) for each text and each grade but the lowest."""
    return 1 - sigmoid(m.thresholds[None, :] - s[:, None])


def train(docs: DataFrame, labels: DataFrame, p: Params = Params(), label: str = "quality", key: str = "doc_id", text: str = "text") -> Model | None:
    """Learn from a bounded sample of rated rows; None if there is none."""
    sample = training_sample(docs, labels, label, p.sample_rows, key, text)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            doc, feature, value = features(texts_of(b), p.bits)
            bounds = pa.array(np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column("order"), b.column("label"), pa.ListArray.from_arrays(bounds, pa.array(feature.astype(np.int32))), pa.ListArray.from_arrays(bounds, pa.array(value.astype(np.float32)))],
                names=["order", "label", "features", "vals"],
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, marks, rows = [], [], []
        for b in batches:
            order += b.column("order").to_pylist()
            marks += b.column("label").to_pylist()
            f, v = b.column("features"), b.column("vals")
            fv, vv, ends = f.values.to_numpy(), v.values.to_numpy(), f.offsets.to_numpy()
            rows += [(fv[x:y].copy(), vv[x:y].astype(np.float64)) for x, y in zip(ends[:-1], ends[1:], strict=True)]
        if not order:
            return
        by = np.argsort(np.array(order, dtype=np.int64), kind="stable")
        m = fit([rows[i] for i in by], np.array(marks)[by], p)
        kinds = ["grade"] * len(m.grades) + ["threshold"] * len(m.thresholds) + ["weight"] * len(m.index)
        at = np.concatenate([np.arange(len(m.grades)), np.arange(len(m.thresholds)), m.index]).astype(np.int64)
        values = np.concatenate([np.array(m.grades, dtype=np.float64), m.thresholds, m.weight])
        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(at), pa.array(values)], names=["kind", "at", "value"])

    seen = sample.select(F.xxhash64(key, F.lit(3)).alias("order"), F.col("label").cast("int").alias("label"), "text")
    found = materialize(seen.mapInArrow(featured, "order long, label int, features array<int>, vals array<float>"), "quality-sample")
    rows = found.repartition(1).mapInArrow(learn, "kind string, at long, value double").toPandas().sort_values("at")
    if not len(rows):
        return None
    of = {k: rows[rows["kind"] == k] for k in ("grade", "threshold", "weight")}
    return Model(p.bits, tuple(int(g) for g in of["grade"]["value"]), of["threshold"]["value"].to_numpy(), of["weight"]["at"].to_numpy(), of["weight"]["value"].to_numpy())


def graded(texts: list[str], dense: np.ndarray, m: Model, min_grade: int) -> tuple[np.ndarray, np.ndarray]:
    """Expected grade and P(grade >= min_grade) of each text."""
    doc, feature, value = features(texts, m.bits)
    tails = probabilities(np.bincount(doc, dense[feature] * value, minlength=len(texts)), m)
    names = np.array(m.grades, dtype=np.float64)
    expected = names[0] + tails @ np.diff(names)
    k = int(np.searchsorted(names, min_grade))
    tail = np.ones(len(texts)) if k == 0 else np.zeros(len(texts)) if k == len(names) else tails[:, k - 1]
    return expected, tail


def rated(docs: DataFrame, model: Model | None, keep: list[str], p: Params = Params(), text: str = "text", only: bool = False) -> DataFrame:
    """The columns `keep` of `docs` with expected_grade, tail (P(grade >= min_grade)) and kept; with
    `only`, the kept rows without these. Null texts count as empty; without a model nothing is
    known against a text: expected_grade is null, tail 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])])
    extra = [] if only else [T.StructField("expected_grade", T.DoubleType()), T.StructField("tail", T.DoubleType()), T.StructField("kept", T.BooleanType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        dense = m.dense() if m else None
        for b in sliced(batches, text):
            expected, tail = graded(texts_of(b, text), dense, m, p.min_grade) if m else (np.full(b.num_rows, np.nan), np.ones(b.num_rows))
            own, good = b.select(keep), pa.array(tail >= p.min_tail)
            if only:
                yield own.filter(good)
            else:
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(expected, from_pandas=True), pa.array(tail), good], names=[*keep, "expected_grade", "tail", "kept"])

    return base.mapInArrow(run, T.StructType([*[base.schema[c] for c in keep], *extra]))


def quality(docs: DataFrame, labels: DataFrame, p: Params = Params(), key: str = "doc_id") -> DataFrame:
    """One row per document: key, held_out, expected_grade, tail, kept.

    Ratings are learned outside the held-out fold only. Repeated rows repeat; see `rated` for nulls
    and missing ratings. An empty table gives no rows. Columns beside key and text may have any name and are not kept.
    """
    out = rated(docs, train(docs, labels, p, key=key), [key], p)
    return out.select(key, held_out(key).alias("held_out"), "expected_grade", "tail", "kept")


def drop_low_quality(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """`docs` without the rows that are not kept; columns, whatever their names, and their order stay. Nulls,
    repeats and empty tables as in `quality`."""
    plain, of = positional(docs)
    return rated(plain, train(docs, labels, p), plain.columns, p, of["text"], only=True).toDF(*docs.columns)

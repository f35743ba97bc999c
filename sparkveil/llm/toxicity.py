"""Toxicity: FTRL-proximal logistic regression over hashed words, word pairs and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, positional, sliced, texts_of
from .learning import held_out, training_sample
from .words import ngram_features


@dataclass(frozen=True)
class Params:
    """bits: features are hashed into 2**bits; sample_rows: bound of the training sample; alpha, beta,
    l1, l2: of the FTRL update; passes: over the sample."""

    bits: int = 20
    sample_rows: int = 16_000
    alpha: float = 5.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.1
    passes: int = 6


@dataclass(frozen=True)
class Model:
    """The non-zero weights only; `bits` bounds their number."""

    bits: int
    bias: float
    index: np.ndarray
    weight: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, dtype=np.float32)
        out[self.index] = self.weight
        return out


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def ftrl(features: list[np.ndarray], labels: np.ndarray, p: Params) -> Model:
    """Learn from documents given as sets of features. Each coordinate has its own rate; the L1 term
    keeps a weight at zero until its evidence exceeds `l1`."""
    z, n = np.zeros(1 << p.bits), np.zeros(1 << p.bits)
    base = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 1e-3
    bias, bias_n = float(np.log(base / (1 - base))), 1.0

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        w = -(zi - np.sign(zi) * p.l1) / ((p.beta + np.sqrt(n[i])) / p.alpha + p.l2)
        w[np.abs(zi) <= p.l1] = 0.0
        return w

    for _ in range(p.passes):
        for i, y in zip(features, labels.tolist(), strict=True):
            w = weights(i)
            g = float(sigmoid(w.sum() + bias)) - y
            root = np.sqrt(n[i])
            n[i] += g * g
            z[i] += g - (np.sqrt(n[i]) - root) / p.alpha * w
            bias_n += g * g
            bias -= p.alpha * g / (p.beta + bias_n**0.5)
    every = np.flatnonzero(np.abs(z) > p.l1)
    return Model(p.bits, bias, every, weights(every).astype(np.float32))


def distinct_features(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text position, feature), sorted."""
    doc, feature = ngram_features(texts, bits)
    keys = np.unique((doc << bits) | feature)
    return keys >> bits, keys & ((1 << bits) - 1)


def train(docs: DataFrame, labels: DataFrame, p: Params = Params(), label: str = "toxic", key: str = "doc_id", text: str = "text") -> Model | None:
    """Learn from a bounded sample of labelled rows; None if there is none."""
    sample = training_sample(docs, labels, label, p.sample_rows, key, text)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            doc, feature = distinct_features(texts_of(b), p.bits)
            bounds = np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(feature.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("order"), b.column("label"), lists], names=["order", "label", "features"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, marks, features = [], [], []
        for b in batches:
            order += b.column("order").to_pylist()
            marks += b.column("label").to_pylist()
            lists = b.column("features")
            values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            features += [values[x:y].copy() for x, y in zip(ends[:-1], ends[1:], strict=True)]
        if not order:
            return
        by = np.argsort(np.array(order, dtype=np.int64), kind="stable")
        m = ftrl([features[i] for i in by], np.array(marks, dtype=np.float64)[by], p)
        index, weight = np.concatenate([[-1], m.index]), np.concatenate([[m.bias], m.weight]).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(index), pa.array(weight)], names=["index", "weight"])

    seen = sample.select(F.xxhash64(key, F.lit(3)).alias("order"), F.col("label").cast("double").alias("label"), "text")
    found = materialize(seen.mapInArrow(featured, "order long, label double, features array<int>"), "toxic-sample")
    rows = found.repartition(1).mapInArrow(learn, "index long, weight double").toPandas().sort_values("index")
    if not len(rows):
        return None
    index, weight = rows["index"].to_numpy(), rows["weight"].to_numpy()
    return Model(p.bits, float(weight[0]), index[1:], weight[1:].astype(np.float32))


def scores(texts: list[str], dense: np.ndarray, bias: float, bits: int) -> np.ndarray:
    """The probability of each text: its distinct features' weights and the bias."""
    doc, feature = ngram_features(texts, bits)
    weight = dense[feature]
    some = weight != 0
    keys = np.unique((doc[some] << bits) | feature[some])
    return sigmoid(bias + np.bincount(keys >> bits, dense[keys & ((1 << bits) - 1)], minlength=len(texts)))


def scored(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text", column: str = "score", below: float | None = None) -> DataFrame:
    """The columns `keep` of `docs` with `column`, the score of the whole text (null text: that of an
    empty one; no model: zero). With `below`, only rows whose score is less, and no score column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])])
    extra = [] if below is not None else [T.StructField(column, T.DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        dense = m.dense() if m else None
        for b in sliced(batches, text):
            s = scores(texts_of(b, text), dense, m.bias, m.bits) if m else np.zeros(b.num_rows)
            own = b.select(keep)
            if below is None:
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(s)], names=[*keep, column])
            else:
                yield own.filter(pa.array(s < below))

    return base.mapInArrow(run, T.StructType([*[base.schema[c] for c in keep], *extra]))


def toxicity(docs: DataFrame, labels: DataFrame, p: Params = Params(), key: str = "doc_id") -> DataFrame:
    """One row per document: key, held_out, score in [0, 1], predicted (1 if score >= 0.5).

    Only texts enter a score. Null and empty texts get the score of a text without words; repeated
    rows repeat; with no labelled rows to learn from every score is 0. An empty table gives no rows. Columns beside key and text may
    have any name and are not kept.
    """
    out = scored(docs, train(docs, labels, p, key=key), [key])
    return out.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, p: Params = Params(), threshold: float = 0.5) -> DataFrame:
    """`docs` without the rows whose score reaches `threshold`; columns, whatever their names, and their order
    stay. Nulls, repeats and empty tables as in `toxicity`."""
    plain, of = positional(docs)
    return scored(plain, train(docs, labels, p), plain.columns, of["text"], below=threshold).toDF(*docs.columns)

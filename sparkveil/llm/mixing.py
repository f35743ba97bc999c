"""Mixing to target weights: iterative proportional fitting of token mass to source, language and topic
marginals, then sampling by the calibrated probabilities.

Tokens are those of the tokenizer that packs them. Topics are clusters of hashed words, fitted on all
documents; what the languages share is taken out first, so that topics don't repeat the languages. Raking is
bounded: a probability never exceeds one, and what a full cell can't give, its neighbours give within the
same marginals. Where the wanted share of the corpus is too much for the targets, less is kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, positional, sliced, written
from .packing import split_words, tokenizer
from .words import FIRST, owners, scattered, word_features, word_hashes

#: What stands for null and for values that have no target.
OTHER = "other"
TARGETS = {
    "source": {"src0": 0.20, **{f"src{i}": round(0.80 / 19, 6) for i in range(1, 20)}},
    "lang": {"en": 0.50, "de": 0.18, "fr": 0.18, "es": 0.14},
}


@dataclass(frozen=True)
class Params:
    """targets: for columns of the documents the wanted share of the tokens by value; topics: clusters to
    fit; temper: a topic's target is its share of the words to this power; topic_starts, topic_rounds: words whose
    documents' mean may start a topic, rounds at most; topic_bits: hashed dimensions, 16 at most; keep: wanted share of all tokens, lowered to `least_keep` at worst where the
    targets need it; sweeps, tolerance: of the raking, in shares; salt: of the sampling hash; max_cells:
    bound of the product of the targets' sizes, which reach the driver; cache_words: as in packing."""

    targets: dict[str, dict[str, float]] = field(default_factory=lambda: TARGETS)
    topics: int = 6
    temper: float = 0.5
    topic_starts: int = 32
    topic_rounds: int = 20
    topic_bits: int = 11
    keep: float = 0.7
    least_keep: float = 0.2
    sweeps: int = 200
    tolerance: float = 5e-4
    salt: str = "mix"
    max_cells: int = 1_000_000
    cache_words: int = 600_000


@dataclass(frozen=True)
class Topics:
    """weight: of each hashed word for each topic; offset: by language, what its mean text scores; share: of all
    words by topic."""

    bits: int
    weight: np.ndarray
    langs: dict[str, int]
    offset: np.ndarray
    share: np.ndarray

    def names(self) -> list[str]:
        return [f"topic{i}" for i in range(len(self.share))]

    def assign(self, texts: list[str], langs: list[str]) -> list[str]:
        """The topic of each whole text; texts without words have none."""
        return self.of_bags(Bags.of(word_counts(texts, self.bits)), np.array([self.langs.get(x, self.langs[OTHER]) for x in langs], dtype=np.int64))

    def of_bags(self, bags: Bags, rows: np.ndarray) -> list[str]:
        """As `assign`, of words and the languages' places."""
        n = bags.sums(bags.times)
        best = (bags.scores(bags.times, self.weight.T) / np.maximum(n, 1)[:, None] - self.offset[rows]).argmax(1)
        return [f"topic{i}" if m else OTHER for i, m in zip(best.tolist(), n.tolist(), strict=True)]


def word_counts(texts: list[str], bits: int) -> np.ndarray:
    """Words of each text by hashed dimension."""
    h, bounds = word_hashes(texts)
    with np.errstate(over="ignore"):
        feature = scattered(h * FIRST, bits)
    return tallied(feature, bounds, bits)


def tallied(feature: np.ndarray, bounds: np.ndarray, bits: int) -> np.ndarray:
    n = len(bounds) - 1
    return np.bincount((owners(bounds) << bits) | feature, minlength=n << bits).reshape(n, -1).astype(np.float64)


def taken(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """`values[at]` for places within bounds, which aren't checked one by one."""
    return values.take(at, mode="clip")


@dataclass(frozen=True)
class Bags:
    """The different hashed words of some texts, one text after the other, how often each occurs, and the bounds of each text."""

    at: np.ndarray
    times: np.ndarray
    bounds: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> Bags:
        own, at = np.nonzero(counts)
        return Bags(at, counts[own, at], np.searchsorted(own, np.arange(len(counts) + 1)))

    def spread(self, values: np.ndarray) -> np.ndarray:
        """For each word the value of its text."""
        return np.repeat(values, np.diff(self.bounds))

    def scores(self, values: np.ndarray, of: np.ndarray) -> np.ndarray:
        """By text and row of `of` the sum of values by word times what the row has for it."""
        return np.stack([self.sums(values * taken(row, self.at)) for row in np.ascontiguousarray(of)], axis=1)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sums over each text of values by word."""
        some = np.diff(self.bounds) > 0
        if some.all() and len(some):
            return np.add.reduceat(values, self.bounds[:-1])
        out = np.zeros(len(some))
        if some.any():
            out[some] = np.add.reduceat(values, self.bounds[:-1][some])
        return out


#: Sums over documents are of multiples of this, so that they are exact and the same in any order up to 2**29 documents
#: (as many hundreds fewer as a text is close to its language's mean).
UNIT = 2.0**-24
Step = Callable[[Bags, np.ndarray], np.ndarray]
#: Sums go from the tasks to where they are added up in pieces of so many.
CHUNK = 1 << 12


def units(x: np.ndarray) -> np.ndarray:
    return np.rint(x * (1 / UNIT))


def tally(at: np.ndarray, weights: np.ndarray | None, rows: int, columns: int) -> np.ndarray:
    return np.bincount(at, weights, minlength=rows * columns).astype(np.float64).reshape(rows, columns)


def fit(total: Callable[[Step, tuple[int, int]], np.ndarray], names: list[str], p: Params) -> Topics | None:
    """Spherical k-means over word frequencies, weighted by rarity, less their language's mean; None without words.

    `total` adds up what a step makes of all documents (their words, and their languages' places in `names`) to an
    array of the shape given. Topics start from the mean documents of the heaviest words, taken far from those
    before; rounds end when no sum changes, or after `topic_rounds`."""
    size, k = 1 << p.topic_bits, len(names)

    def seen(bags: Bags, rows: np.ndarray) -> np.ndarray:
        n = bags.sums(bags.times)
        docs = np.resize(np.bincount(rows[n > 0], minlength=k), (1, size)) * (np.arange(size) < k)
        return np.vstack([np.bincount(bags.at, minlength=size), tally(bags.spread(rows * size) + bags.at, units(bags.times / bags.spread(n)), k, size), docs])

    got = total(seen, (k + 2, size))
    held, sums, docs = got[0], got[1:-1] * UNIT, got[-1][:k]
    if not docs.sum():
        return None
    rarity = np.log((1 + docs.sum()) / (1 + held))
    means = np.where(docs[:, None] > 0, sums / np.maximum(docs, 1)[:, None], sums.sum(0) / docs.sum()) * rarity

    twice, lengths = (2 * means).ravel(), (means * means).sum(1)

    def unit(x: np.ndarray) -> np.ndarray:
        norm = np.sqrt((x * x).sum(1, keepdims=True))
        return np.where(norm > 1e-6, x / np.maximum(norm, 1e-6), 0.0)

    def weights(bags: Bags) -> np.ndarray:
        """By word its share of its text by its rarity."""
        x = bags.times / bags.spread(bags.sums(bags.times))
        x *= taken(rarity, bags.at)
        return x

    def scales(bags: Bags, rows: np.ndarray, x: np.ndarray) -> np.ndarray:
        """By text what brings weights less the language's mean to length 1 (0 where that is nothing)."""
        less = x - taken(twice, bags.spread(rows * size) + bags.at)
        less *= x
        apart = bags.sums(less) + lengths[rows]
        return np.where(apart > 1e-12, 1 / np.sqrt(np.maximum(apart, 1e-12)), 0.0)

    def less_means(got: np.ndarray) -> np.ndarray:
        """Summed weights, then summed scales by language, as sums of texts of length 1 less their means."""
        return unit((got[:, :size] - got[:, size:] @ means) * UNIT)

    mass = sums.sum(0) * rarity
    heavy = np.argsort(-mass, kind="stable")[: p.topic_starts]
    order = np.full(size, -1)
    order[heavy] = np.arange(len(heavy))

    def around(bags: Bags, rows: np.ndarray) -> np.ndarray:
        x = weights(bags)
        scale, own, at = scales(bags, rows, x), bags.spread(np.arange(len(rows))), order[bags.at]
        dense = tally(own * size + bags.at, units(x * bags.spread(scale)), len(rows), size)
        has = tally(at[at >= 0] * len(rows) + own[at >= 0], None, len(heavy), len(rows))
        return np.hstack([has @ dense, has @ (units(scale)[:, None] * (rows[:, None] == np.arange(k)))])

    starts = less_means(total(around, (len(heavy), size + k)))
    starts = starts[(mass[heavy] > 0) & starts.any(1)]
    if not len(starts):  # all texts are alike
        starts = np.zeros((1, size))
    picks = [0]
    for _ in range(min(p.topics, len(starts)) - 1):
        near = (starts @ starts[picks].T).max(1)
        near[picks] = np.inf
        picks.append(int(near.argmin()))
    centres, last = starts[picks], None

    def nearest(bags: Bags, rows: np.ndarray, x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return (bags.scores(x, centres) - (means @ centres.T)[rows]).argmax(1)

    for _ in range(p.topic_rounds):

        def moved(bags: Bags, rows: np.ndarray, centres: np.ndarray = centres) -> np.ndarray:
            x, n = weights(bags), len(centres)
            topic, scale = nearest(bags, rows, x, centres), scales(bags, rows, x)
            x *= bags.spread(scale)
            return np.hstack([tally(bags.spread(topic * size) + bags.at, units(x), n, size), tally(topic * k + rows, units(scale), n, k)])

        now = total(moved, (len(centres), size + k))
        if last is not None and (now == last).all():
            break
        last, new = now, less_means(now)
        centres = np.where(new.any(1, keepdims=True), new, centres)

    def words(bags: Bags, rows: np.ndarray) -> np.ndarray:
        return tally(nearest(bags, rows, weights(bags), centres), bags.sums(bags.times), len(centres), 1)

    held = total(words, (len(centres), 1))[:, 0]
    by = np.argsort(-held, kind="stable")
    return Topics(p.topic_bits, (centres[by] * rarity).T.copy(), {v: i for i, v in enumerate(names)}, means @ centres[by].T, (held / held.sum())[by])


def cluster(counts: np.ndarray, langs: list[str], p: Params) -> Topics | None:
    """`fit` of word counts in memory."""
    some, names = np.flatnonzero(counts.sum(1)), sorted({*langs, OTHER})
    rows = np.array([names.index(v) for v in langs], dtype=np.int64)[some]
    return fit(lambda step, shape: step(Bags.of(counts[some]), rows), names, p)


def languages(p: Params) -> list[str]:
    """What a text's language may be to the topics, by place."""
    return sorted({*p.targets.get("lang", {}), OTHER})


def fit_worded(rows: DataFrame, p: Params) -> Topics | None:
    """Topics from the hashed words of all rows of `worded`. Each task adds up its own documents, some tens of thousands of
    words at a time, and reads several files, since there are many passes over few bytes; only the sums over all, whose number
    `Params` bounds, reach the driver."""
    read = rows.select(*BLOB)
    parts = read.rdd.getNumPartitions()
    read = read.coalesce(max(1, parts // 4, min(parts, rows.sparkSession.sparkContext.defaultParallelism)))

    def total(step: Step, shape: tuple[int, int]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(shape)
            for bags, langs in bagged(batches, some=True):
                out += step(bags, langs)
            flat = out.ravel()
            for i in range(0, len(flat), CHUNK):
                if flat[i : i + CHUNK].any():
                    yield pa.RecordBatch.from_arrays([pa.array([i // CHUNK], pa.int32()), pa.array([flat[i : i + CHUNK].astype("<f8").tobytes()], pa.binary())], names=["chunk", "sums"])

        def add(part: pa.Table) -> pa.Table:
            sums = sum(np.frombuffer(x.as_buffer(), "<f8") for x in part.column("sums"))
            return pa.table({"chunk": part.column("chunk")[:1], "sums": pa.array([sums.tobytes()], pa.binary())})

        schema = "chunk int, sums binary"
        out = np.zeros(math.prod(shape))
        for chunk, sums in read.mapInArrow(run, schema).groupBy("chunk").applyInArrow(add, schema).collect():
            out[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(sums, "<f8")
        out = out.reshape(shape)
        return out

    return fit(total, languages(p), p)


def fit_topics(docs: DataFrame, p: Params, key: str, text: str, lang: str | None) -> Topics | None:
    """Topics from all documents, repeated keys and none included; None if no text has words."""
    plain, of = positional(docs)
    p = p if lang is not None else replace(p, targets={})
    return fit_worded(materialize(worded(plain, {"lang": of[lang]} if lang is not None else {}, replace(p, targets={d: t for d, t in p.targets.items() if d == "lang"}), None, [], of[text]), "mix-words"), p)


def wanted(p: Params, topics: Topics | None) -> dict[str, dict[str, float]]:
    """The targets by dimension, topics with theirs."""
    if topics is None:
        return dict(p.targets)
    flat = topics.share**p.temper * (topics.share > 0)
    return p.targets | {"topic": dict(zip(topics.names(), (flat / flat.sum()).tolist(), strict=True))}


#: The columns of `worded` with the words of a slice of documents: the hashed words of each (two bytes each, each once), how
#: often each occurs (one, two or four bytes), by document how many there are and the place of its language.
BLOB = ("words", "times", "sizes", "langs")


def bagged(batches: Iterator[pa.RecordBatch], some: bool = False, entries: int = 1 << 15) -> Iterator[tuple[Bags, np.ndarray]]:
    """Of the rows of `worded` the words and languages of about as many documents at a time as hold `entries` different
    words, so that they stay in a core's cache; with `some` only of documents with words."""
    for batch in batches:
        for i in range(batch.num_rows):
            words, times, sizes, langs = (memoryview(batch.column(c)[i].as_buffer()) for c in BLOB)
            at, sizes, langs = np.frombuffer(words, "<u2"), np.frombuffer(sizes, "<u4").astype(np.int64), np.frombuffer(langs, "<u2").astype(np.int64)
            times = np.frombuffer(times, f"<u{len(times) // max(len(at), 1) or 1}")
            if some:
                sizes, langs = sizes[sizes > 0], langs[sizes > 0]
            bounds, start = np.concatenate([[0], np.cumsum(sizes)]), 0
            while start < len(sizes):
                stop = max(start + 1, int(np.searchsorted(bounds, bounds[start] + entries, side="right")) - 1)
                stop = min(stop, start + 2000, len(sizes))
                first, past = bounds[start], bounds[stop]
                yield Bags(at[first:past].astype(np.int64), times[first:past].astype(np.float64), bounds[start : stop + 1] - first), langs[start:stop]
                start = stop


class Reader:
    """What the texts of a slice hold: values of the targets, hashed words, languages' places and tokens. One a task."""

    def __init__(self, of: dict[str, str], p: Params, path: str | None) -> None:
        self.of, self.p, self.tokens = of, p, tokenizer(path, p.cache_words) if path else None
        self.known = {d: frozenset(shares) - {OTHER} for d, shares in p.targets.items()}
        self.places = {v: i for i, v in enumerate(languages(p))}

    def cells(self, b: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([v if v in known else OTHER for v in b.column(self.of[d]).to_pylist()], pa.string()) for d, known in self.known.items()]

    def langs(self, b: pa.RecordBatch) -> np.ndarray:
        if "lang" not in self.known:
            return np.zeros(b.num_rows, np.int64)
        return np.array([self.places.get(v, self.places[OTHER]) for v in b.column(self.of["lang"]).to_pylist()], dtype=np.int64)

    def bags(self, coded: pa.DictionaryArray, bounds: np.ndarray, places: np.ndarray | None = None) -> Bags:
        """From `split_words`, with a tokenizer also from the `places` of its dictionary: what follows a head holds no word."""
        bits = self.p.topic_bits
        index = coded.indices.to_numpy(zero_copy_only=False)
        if places is None:
            pool, sizes = word_features(coded.dictionary, bits)
            starts, lengths = (np.cumsum(sizes) - sizes)[index], sizes[index]
        else:
            (pool, ends), at = self.tokens.features(bits), places[:, 0]
            starts, lengths = ends[at][index], (ends[at + 1] - ends[at])[index]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        feature = pool[np.repeat(starts - ends[:-1], lengths) + np.arange(ends[-1])]
        found, times = np.unique((owners(ends[bounds]) << bits) | feature, return_counts=True)
        return Bags(found & ((1 << bits) - 1), times.astype(np.float64), np.searchsorted(found, np.arange(len(bounds)) << bits))


def worded(docs: DataFrame, of: dict[str, str], p: Params, path: str | None, keep: list[str], text: str) -> DataFrame:
    """A row for a slice of documents of `docs` (named by position): `BLOB` unless there are no topics, and as lists with an item
    for each document the columns `keep`, an `in_` column for each target and, with the `path` of a tokenizer, the mass, tokens
    and end id. The text is read once, whole, in Arrow batches; null counts as empty."""
    if p.topic_bits > 16:
        raise ValueError("topic_bits is 16 at most")
    base = docs.select(*dict.fromkeys([*keep, *(of[d] for d in p.targets), text]))
    items = [*[(c, base.schema[c].dataType) for c in keep], *[(f"in_{d}", T.StringType()) for d in p.targets], *([("mass", T.LongType())] if path else [])]
    fields = [*([T.StructField(c, T.BinaryType()) for c in BLOB] if p.topics else []), *[T.StructField(c, T.ArrayType(t)) for c, t in items]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(of, p, path)
        for b in sliced(batches, text, max_bytes=2 << 20):
            coded, bounds = split_words(b.column(text))
            places = reader.tokens.places(coded.dictionary) if path else None
            blob, columns = [], [*(b.column(c) for c in keep), *reader.cells(b)]
            if p.topics:
                bags = reader.bags(coded, bounds, places)
                most = bags.times.max(initial=0)
                width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4
                blob = [x.astype(t).tobytes() for x, t in zip((bags.at, bags.times, np.diff(bags.bounds), reader.langs(b)), ("<u2", f"<u{width}", "<u4", "<u2"), strict=True)]
            if path:
                columns.append(pa.array(reader.tokens.count(places, coded, bounds) + 1))
            lists = [pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), c) for c in columns]
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.binary()) for x in blob), *lists], names=[f.name for f in fields])

    return base.mapInArrow(run, T.StructType(fields))


def placed(rows: DataFrame, topics: Topics | None, p: Params) -> DataFrame:
    """The documents of `worded`, a row each, with their topic in place of their words."""
    fields = [T.StructField(f.name, f.dataType.elementType) for f in rows.schema if f.name not in BLOB]
    shown = [*fields, *([T.StructField("in_topic", T.StringType())] if topics is not None else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = batch.slice(i, 1)
                columns = [b.column(f.name).flatten() for f in fields]
                if topics is not None:
                    columns.append(pa.array([x for bags, langs in bagged([b]) for x in topics.of_bags(bags, langs)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in shown])

    return rows.mapInArrow(run, T.StructType(shown))


def marked(docs: DataFrame, of: dict[str, str], topics: Topics | None, p: Params, text: str) -> DataFrame:
    """`docs` (named by position) with an `in_` column for each target and the topic."""
    fields = [*docs.schema.fields, *[T.StructField(f"in_{d}", T.StringType()) for d in p.targets], *([T.StructField("in_topic", T.StringType())] if topics is not None else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(of, p, None)
        for b in sliced(batches, text, max_bytes=2 << 20):
            columns = [*b.columns, *reader.cells(b)]
            if topics is not None:
                columns.append(pa.array(topics.of_bags(reader.bags(*split_words(b.column(text))), reader.langs(b)), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.mapInArrow(run, T.StructType(fields))


def _factor(u: np.ndarray, mass: np.ndarray, goal: float) -> float:
    """The f with which sum(min(1, f * u) * mass) is `goal`; where all of the mass is less, the least f that gives all."""
    u, by = np.sort(u)[::-1], np.argsort(-u, kind="stable")
    m = mass[by]
    if goal >= m.sum():
        return 1.0 / u[-1]
    full = np.cumsum(m) - m  # the mass of the cells before, which give all
    f = (goal - full) / np.cumsum((m * u)[::-1])[::-1]
    return float(f[np.flatnonzero((f * u <= 1) & (f > 0))[0]])


def rake(mass: np.ndarray, codes: list[np.ndarray], goals: list[np.ndarray], p: Params, keep: float) -> tuple[np.ndarray, float]:
    """Probabilities of the cells, at most 1, by which the kept mass is `keep` of all and has the wanted shares,
    and by how much a share is missed at worst. Each step scales a value's cells; those that reach 1 stay
    there and the others give the rest."""
    u, total = np.full(len(mass), keep), keep * mass.sum()
    worst = math.inf
    for _ in range(p.sweeps):
        for code, goal in zip(codes, goals, strict=True):
            for v, share in enumerate(goal):
                own = code == v
                u[own] = u[own] * _factor(u[own], mass[own], share * total) if share > 0 else 0.0
                u[own] = np.maximum(u[own], 1e-300)
        kept = np.minimum(u, 1.0) * mass
        worst = max(float(np.abs(np.bincount(c, kept, minlength=len(g)) / total - g).max()) for c, g in zip(codes, goals, strict=True))
        if worst <= p.tolerance:
            break
    return np.minimum(u, 1.0), worst


def calibrate(cells: pd.DataFrame, goals: dict[str, dict[str, float]], p: Params) -> pd.DataFrame:
    """`cells` (in_ columns and mass, a row for each filled cell) with probability, weight (probability by the
    kept share) and each dimension's wanted and achieved share of the row's value.

    Values without mass leave their share to the others of the dimension; mass without a target (`other`) keeps
    its own share. If `keep` is too much for the targets, the largest share of the tokens that isn't is kept,
    found by bisection, but `least_keep` at least; then targets beyond reach are met as far as can be.
    """
    dims = list(goals)
    cells = cells.sort_values([f"in_{d}" for d in dims], ignore_index=True)
    if not len(cells):
        return cells.assign(probability=0.0, weight=0.0, **{f"{d}_{x}": 0.0 for d in dims for x in ("wanted", "achieved")})
    mass, codes, shares = cells["mass"].to_numpy(dtype=float), [], []
    for d in dims:
        names, code = np.unique(cells[f"in_{d}"].to_numpy(dtype=str), return_inverse=True)
        own = np.bincount(code, mass) / mass.sum()
        goal = np.array([0.0 if v == OTHER else goals[d][v] for v in names])
        left = float(own[names == OTHER].sum())
        goal = goal / goal.sum() * (1 - left) if goal.sum() else goal
        codes.append(code)
        shares.append(np.where(names == OTHER, own, goal))
    keep = p.keep
    probability, worst = rake(mass, codes, shares, p, keep)
    if worst > p.tolerance:
        low, high = min(p.least_keep, p.keep), p.keep
        for _ in range(10):
            middle = (low + high) / 2
            low, high = (middle, high) if rake(mass, codes, shares, p, middle)[1] <= p.tolerance else (low, middle)
        keep = low
        probability, _ = rake(mass, codes, shares, p, keep)
    cells = cells.assign(probability=probability, weight=probability / keep)
    kept = probability * mass
    for d, code, goal in zip(dims, codes, shares, strict=True):
        cells[f"{d}_wanted"], cells[f"{d}_achieved"] = goal[code], (np.bincount(code, kept) / max(kept.sum(), 1e-300))[code]
    return cells


def _table(summed: DataFrame, goals: dict, p: Params) -> DataFrame:
    """The cells with what `calibrate` adds, as a table to broadcast."""
    cells = calibrate(summed.toPandas(), goals, p)
    fields = [*(f"in_{d} string" for d in goals), "weight double", "probability double", *(f"{d}_{x} double" for d in goals for x in ("wanted", "achieved"))]
    names = [f.split()[0] for f in fields]
    return summed.sparkSession.createDataFrame([tuple(r) for r in cells[names].itertuples(index=False)], ", ".join(fields))


def _sampled(key: str, p: Params) -> F.Column:
    text = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(f":{p.salt}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32) < F.col("probability")


def _plan(docs: DataFrame, path: str, p: Params, key: str, text: str, keep: tuple[str, ...]) -> tuple:
    """`docs` by position, the names there, its rows with their cells and mass, the topics, and the cells' table."""
    plain, of = positional(docs)
    if missing := [d for d in p.targets if d not in of]:
        raise ValueError(f"no columns {missing}")
    size = math.prod(len(shares) + 1 for shares in p.targets.values()) * (p.topics + 1)
    if size > p.max_cells:
        raise ValueError(f"the targets span {size} cells; max_cells is {p.max_cells}")
    rows, words = written(worded(plain, of, p, path, list(dict.fromkeys(of[c] for c in keep)), of[text]), "mix-words")
    topics = fit_worded(rows, p) if p.topics else None
    goals, rows = wanted(p, topics), materialize(placed(rows, topics, p), "mix-rows")
    discard(docs.sparkSession, words)
    return plain, of, rows, topics, goals, _table(rows.groupBy(*[f"in_{d}" for d in goals]).agg(F.sum("mass").alias("mass")), goals, p)


def weigh(docs: DataFrame, path: str, p: Params = Params(), key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of `docs`, then for each dimension <name>_group, <name>_wanted, <name>_achieved (shares of
    the tokens kept), and tokens, weight, probability, sampled.

    Tokens are summed by cell on Spark; only the cells, whose number the targets bound, reach the driver. A
    document is sampled if the hash of its key (null: of the word null) lies below its probability; repeated
    keys share their fate. Null and empty texts have one token, the end id, and no topic. An empty table
    stays empty; columns that aren't kept may have any name.
    """
    _, of, rows, _, goals, table = _plan(docs, path, p, key, text, (*keep, key))
    found = rows.join(F.broadcast(table), [f"in_{d}" for d in goals]).withColumn("sampled", _sampled(of[key], p))
    shown = [c for d in goals for c in (F.col(f"in_{d}").alias(f"{d}_group"), F.col(f"{d}_wanted"), F.col(f"{d}_achieved"))]
    return found.select(*[F.col(of[c]).alias(c) for c in keep], *shown, F.col("mass").alias("tokens"), "weight", "probability", "sampled")


def mix(docs: DataFrame, path: str, p: Params = Params(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The sampled rows of `docs`; columns, whatever their names, and their order stay. See `weigh`."""
    plain, of, _, topics, goals, table = _plan(docs, path, p, key, text, ())
    rows = marked(plain, of, topics, p, of[text])
    return rows.join(F.broadcast(table), [f"in_{d}" for d in goals]).where(_sampled(of[key], p)).select(*plain.columns).toDF(*docs.columns)

"""Embedding whitening by digit-slice matrix products.

Vectors become integers x. With n distinct vectors and their sums S, y = n * x - S is centred and still integer. y is cut
into signed digits of 20 bits; products of digit matrices are exact in float64 as long as a block has few enough rows, so BLAS
does the work. Each task puts its digits' products together as big integers; these travel as digits again, Spark adds
them up, and the driver gets width * width exact sums: n**3 times the covariance.

The eigenvectors are those of float64, made accurate for small eigenvalues too: the covariance is turned into their basis with
exact products, where it is nearly diagonal, and Jacobi rotations with a relative bound finish it.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

DIGIT = 20
#: Products of two digits (2 * 19 bits) and the sum of this many of them stay under 2**53.
BLOCK_ROWS = 4096
#: Bits of the digits in which big integers travel.
PLACE = 40
#: Bits of the fraction of a basis vector's components.
FRACTION = 60
INT_BITS = 62
SUMS = "i int, j int, place int, digit long"


@dataclass(frozen=True)
class Params:
    """scale: of the entries before they are cut to integers; components: at most, by falling eigenvalue; max_width:
    longest vector, since a task holds some width * width matrices; peak: integers beyond it count as it; least:
    smallest eigenvalue, as a part of the largest, that double precision can still whiten."""

    scale: int = 256
    components: int = 4
    max_width: int = 2048
    peak: int = 1 << 60
    least: float = 1e-20


def slices(y: np.ndarray) -> list[np.ndarray]:
    """Integers (int64 under 2**62, or Python's) as signed digits of base 2**20, lowest first, in float64."""
    out = []
    half, mask = 1 << (DIGIT - 1), (1 << DIGIT) - 1
    while not out or y.any():
        low = ((y + half) & mask) - half
        out.append(low.astype(np.float64))
        y = (y - low) >> DIGIT
    return out


class Total:
    """Sums of digit products by their place, as big integers in the end."""

    def __init__(self) -> None:
        self.parts: dict[int, np.ndarray] = {}
        self.whole, self.added = 0, 0

    def add(self, place: int, product: np.ndarray) -> None:
        if place in self.parts:
            self.parts[place] += product.astype(np.int64)
        else:
            self.parts[place] = product.astype(np.int64)
        self.added += 1
        if self.added >= 2048:  # each is at most 2**51
            self.whole, self.parts, self.added = self.value(), {}, 0

    def value(self) -> np.ndarray:
        return self.whole + sum(part.astype(object) << (DIGIT * place) for place, part in self.parts.items())


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact product of two integer matrices, as Python integers."""
    total = Total()
    for start in range(0, a.shape[1], BLOCK_ROWS):
        left, right = slices(a[:, start : start + BLOCK_ROWS]), slices(b[start : start + BLOCK_ROWS])
        for i, p in enumerate(left):
            for j, q in enumerate(right):
                total.add(i + j, p @ q)
    return total.value()


def add_gram(total: Total, y: np.ndarray) -> None:
    """Add y.T @ y of a block of at most BLOCK_ROWS rows."""
    cut = slices(y)
    for i, p in enumerate(cut):
        total.add(2 * i, p.T @ p)
        for j in range(i):
            cross = p.T @ cut[j]
            total.add(i + j, cross + cross.T)


def squares(y: np.ndarray) -> list[int]:
    """Each row's sum of squares, exactly."""
    cut = slices(y)
    out = np.zeros(len(y), object)
    for i, p in enumerate(cut):
        for j, q in enumerate(cut[: i + 1]):
            out += (np.einsum("ij,ij->i", p, q).astype(np.int64) * (1 if i == j else 2)).astype(object) << (DIGIT * (i + j))
    return out.tolist()


def padded(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows; shorter ones end in zeros."""
    if not width:
        return np.zeros((len(column), 0), np.int64)
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = values
    return out


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    rows = max(1, min(BLOCK_ROWS, (1 << 21) // max(width, 1)))
    for whole in batches:
        for start in range(0, whole.num_rows, rows):
            b = whole.slice(start, rows)
            yield b, padded(b.column("x"), width)


def _sums(found: Iterator[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
    """Big integers (i, j, value) as rows of signed digits."""
    rows: list[tuple[int, int, int, int]] = []
    half, mask = 1 << (PLACE - 1), (1 << PLACE) - 1

    def batch() -> pa.RecordBatch:
        i, j, place, digit = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(place, pa.int32()), pa.array(digit, pa.int64())], names=["i", "j", "place", "digit"])

    for i, j, value in found:
        place = 0
        while value:
            low = ((value + half) & mask) - half
            if low:
                rows.append((i, j, place, low))
            value, place = (value - low) >> PLACE, place + 1
        if len(rows) >= 50_000:
            yield batch()
            rows.clear()
    if rows:
        yield batch()


def _gathered(parts: DataFrame) -> dict[tuple[int, int], int]:
    """The tasks' digits added up, as big integers by (i, j)."""
    out: dict[tuple[int, int], int] = defaultdict(int)
    for r in parts.groupBy("i", "j", "place").agg(F.sum(F.col("digit").cast("decimal(20,0)")).alias("digit")).collect():
        out[r["i"], r["j"]] += int(r["digit"]) << (PLACE * r["place"])
    return out


def rotated(b: np.ndarray) -> np.ndarray:
    """The rotations that make a nearly diagonal, positive semidefinite matrix diagonal, to full precision relative to
    each pair of diagonal entries."""
    b, turn, eps = b.copy(), np.eye(len(b)), np.finfo(float).eps
    for _ in range(40):
        root = np.sqrt(np.abs(np.diag(b)))
        pairs = np.argwhere(np.triu(np.abs(b) > eps * np.outer(root, root), 1))
        if not len(pairs):
            break
        for i, j in pairs.tolist():
            if abs(b[i, j]) <= eps * math.sqrt(abs(b[i, i] * b[j, j])):
                continue
            theta = (b[j, j] - b[i, i]) / (2 * b[i, j])
            t = math.copysign(1.0, theta) / (abs(theta) + math.hypot(1.0, theta))
            c = 1 / math.hypot(1.0, t)
            s = t * c
            b[:, [i, j]] = np.stack([c * b[:, i] - s * b[:, j], s * b[:, i] + c * b[:, j]], 1)
            b[[i, j], :] = np.stack([c * b[i] - s * b[j], s * b[i] + c * b[j]])
            b[i, j] = b[j, i] = 0.0
            turn[:, [i, j]] = np.stack([c * turn[:, i] - s * turn[:, j], s * turn[:, i] + c * turn[:, j]], 1)
    return turn


def principal(gram: np.ndarray, count: int, least: float = Params.least) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Unit eigenvectors (columns) of an exact integer matrix and their eigenvalues as exact fractions, by falling value: `count`
    at most, and none under `least` of the largest."""
    top = max(gram.diagonal(), default=0)
    if not top:
        return np.zeros((len(gram), 0)), []
    _, basis = np.linalg.eigh((gram / top).astype(np.float64))
    fixed = np.rint(basis * 2.0**FRACTION).astype(np.int64).astype(object)
    turned = product(product(fixed.T, gram), fixed)
    vectors = basis @ rotated((turned / (top << (2 * FRACTION))).astype(np.float64))
    vectors /= np.sqrt((vectors * vectors).sum(0))
    fixed = np.rint(vectors * 2.0**FRACTION).astype(np.int64).astype(object)
    over = (fixed * product(gram, fixed)).sum(0)
    under = (fixed * fixed).sum(0)
    size = [o / (u * top) for o, u in zip(over, under, strict=True)]
    order = sorted(range(len(gram)), key=lambda k: -size[k])[:count]
    order = [k for k in order if size[k] > least * size[order[0]]]
    return vectors[:, order], [(over[k], under[k]) for k in order]


def whiten(vectors: DataFrame, p: Params = Params(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per usable vector and component: key, component, n, deviation, whitened, explained, identity_error.

    deviation is decimal(38,0), null beyond 38 digits. Vectors that are null or hold null or non-finite entries have no row.
    Vectors shorter than the longest count as ending in zeros, empty ones as all zeros; longer ones than max_width are
    an error, as the result would be width * width numbers. Entries whose integer lies beyond `peak` count as `peak`. Repeated
    rows and equal vectors have rows each and count once in the fit. There are fewer components where the vectors span fewer
    dimensions: none, and so no rows, if all are equal. Equal eigenvalues: any basis of theirs, the same for all rows. Null keys
    are kept as they are. An empty table gives no rows. Columns beside key and vector may have any name and are not kept.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    usable = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    bounded = lambda c: F.least(F.greatest(c * p.scale, F.lit(float(-p.peak))), F.lit(float(p.peak)))
    rows = vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where(F.coalesce(usable, F.lit(False)))
    rows = rows.select("id", F.transform(v, lambda c: F.floor(bounded(c))).alias("x"))
    schema = T.StructType([
        T.StructField(key, rows.schema["id"].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.DecimalType(38, 0)),
        T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
    ])
    fit = materialize(rows.select("x").distinct(), "whiten-fit")
    n, width, shortest, peak = fit.agg(F.count("*"), F.max(F.size("x")), F.min(F.size("x")), F.max(F.array_max(F.transform("x", F.abs)))).first()
    width, peak = width or 0, peak or 0
    if width > p.max_width:
        raise ValueError(f"a vector has {width} components; max_width is {p.max_width}")
    if n and shortest < width:  # some are equal but for the zeros at their ends
        ended = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x")))
        fit = materialize(fit.select(ended.alias("x")).distinct(), "whiten-fit")
        n = fit.count()
    wide = peak * 2 * max(n, 1) >= 1 << INT_BITS  # else n * x - S fits int64

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, object)
        for _, x in _blocks(batches, width):
            total = total + (x.astype(object) if peak >= 1 << 50 else x).sum(0)
        yield from _sums((i, 0, int(t)) for i, t in enumerate(total))

    sums = _gathered(fit.mapInArrow(add_up, SUMS))
    shift = np.array([sums.get((i, 0), 0) for i in range(width)], object if wide else np.int64)

    def centred(x: np.ndarray) -> np.ndarray:
        return (x.astype(object) if wide else x) * n - shift

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Total()
        for _, x in _blocks(batches, width):
            add_gram(total, centred(x))
        g = total.value()
        if isinstance(g, np.ndarray):
            yield from _sums((i, j, int(g[i, j])) for i in range(width) for j in range(i + 1))

    gram = np.zeros((width, width), object)
    for (i, j), value in _gathered(fit.mapInArrow(multiply, SUMS)).items():
        gram[i, j] = gram[j, i] = value
    axes, values = principal(gram, p.components, p.least)
    if not values:
        return spark.createDataFrame([], schema)
    trace = int(sum(gram.diagonal()))
    explained = [over / (under * trace) for over, under in values]
    # x's deviation from the mean is y / n, an eigenvalue over / under / n**3
    spread = np.array([math.sqrt(over / (under * n)) for over, under in values])
    shared = spark.sparkContext.broadcast((axes, spread))

    def projected(y: np.ndarray) -> np.ndarray:
        axes, spread = shared.value
        return (y.astype(np.float64) @ axes) / spread

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        total = np.zeros((k, k + 1))
        for _, x in _blocks(batches, width):
            w = projected(centred(x))
            total += w.T @ np.column_stack([w, np.ones(len(w))])
        i, j = np.indices(total.shape).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "total"])

    found = np.zeros((len(values), len(values) + 1))
    for r in fit.mapInArrow(moments, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        found[r["i"], r["j"]] = r["total"] / n
    covariance = found[:, :-1] - np.outer(found[:, -1], found[:, -1])
    identity_error = float(np.abs(covariance - np.eye(len(values))).max())

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(values)
        for b, x in _blocks(batches, width):
            y = centred(x)
            deviation = pa.array([Decimal(d) if d < 10**38 else None for d in squares(y)], pa.decimal128(38, 0))
            each = pa.array(np.repeat(np.arange(b.num_rows), k))
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)), pa.array(np.full(k * b.num_rows, n)), deviation.take(each),
                 pa.array(projected(y).ravel()), pa.array(np.tile(explained, b.num_rows)), pa.array(np.full(k * b.num_rows, identity_error))],
                names=schema.names,
            )

    return rows.mapInArrow(lay_out, schema)

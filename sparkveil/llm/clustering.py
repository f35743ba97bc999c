"""Centroid clustering of integer vectors by sort-means.

Each round orders, for every centroid, the others by their distance from it. A vector starts at the centroid it had in
the round before and goes through that centroid's list; once the next centroid lies strictly further from the starting
one than twice the vector's distance to it, no later one can be as near, by the triangle inequality. An equal
distance could still be a tie, so equality goes on. All distances are squared integers, and so are the comparisons.

Vectors with their assignment are written once a round to the shared folder, beside one row of sums for each task and
cluster; the driver gets clusters x components sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, new_path

BLOCK_ROWS = 4096
LONGEST = 2**63 - 1


@dataclass(frozen=True)
class Params:
    """clusters; rounds of moving the centroids; width: components of a vector; scale: what they are multiplied by;
    salt: of the hash that draws the first centroids; peak: components beyond it count as it, so that squared
    distances fit a long (64 components of 2**28 do)."""

    clusters: int = 16
    rounds: int = 3
    width: int = 64
    scale: int = 64
    salt: str = "1"
    peak: int = 1 << 27


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of two integer arrays."""
    apart = x - y
    return np.einsum("ij,ij->i", apart, apart)


class Centroids:
    """Centroids, and for each the others from near to far."""

    def __init__(self, centres: np.ndarray) -> None:
        self.centres = centres.astype(np.int64)
        k = len(centres)
        gaps = np.stack([squared(self.centres, c[None, :]) for c in self.centres])
        self.order = [[int(j) for j in np.argsort(gaps[a], kind="stable") if j != a] for a in range(k)]
        self.least = -(-gaps // 4)  # gap > 4 * d, for an integer d, says the same as ceil(gap / 4) > d

    def nearest(self, x: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row, of equally near ones the smallest number, and the squared distance;
        before: the centroid that each row's scan starts from."""
        own, best = before.copy(), squared(x, self.centres[before])
        for a in np.unique(before).tolist():
            rows = np.flatnonzero(before == a)
            start = best[rows]
            for j in self.order[a]:
                reached = start >= self.least[a, j]
                if not reached.any():
                    break
                rows, start = rows[reached], start[reached]
                d = squared(x[rows], self.centres[j][None, :])
                nearer = (d < best[rows]) | ((d == best[rows]) & (j < own[rows]))
                at = rows[nearer]
                own[at], best[at] = j, d[nearer]
        return own, best


def integers(vectors: DataFrame, p: Params, key: str, vector: str) -> DataFrame:
    """The usable vectors: id, x as array<int>."""
    v = F.col("v")
    usable = v.isNotNull() & (F.size(v) == p.width) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where(F.coalesce(usable, F.lit(False)))
    bounded = lambda c: F.least(F.greatest(c * p.scale, F.lit(float(-p.peak))), F.lit(float(p.peak)))
    return rows.select("id", F.transform(v, lambda c: F.floor(bounded(c)).cast("int")).alias("x"))


def first_centroids(rows: DataFrame, p: Params) -> np.ndarray:
    """The vectors whose keys have the smallest hashes, in the hashes' order."""
    drawn = F.sha2(F.concat(F.lit(f"{p.salt}:"), F.col("id").cast("string")), 256)
    return np.array([r["x"] for r in rows.orderBy(drawn.asc_nulls_last(), "x").limit(p.clusters).collect()], dtype=np.int64)


def _round(rows: DataFrame, centres: np.ndarray, last: bool) -> str:
    """Assign `rows` (id, x, cluster) to `centres` and write them, part 0, with the tasks' sums, part 1: the count of
    a cluster before its components' sums, and the sum of distances. The last round drops x. Returns the path."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(centres)
    schema = T.StructType([
        T.StructField("id", rows.schema["id"].dataType), T.StructField("x", T.ArrayType(T.IntegerType())), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()),
        T.StructField("sums", T.ArrayType(T.LongType())), T.StructField("inertia", T.DecimalType(38, 0)), T.StructField("part", T.IntegerType()),
    ])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Centroids(shared.value)
        k, width = shared.value.shape
        sums, inertia = np.zeros((k, width + 1), np.int64), [0] * k
        kind = None
        for whole in batches:
            kind = whole.schema.field("id").type
            for begin in range(0, whole.num_rows, BLOCK_ROWS):
                b = whole.slice(begin, BLOCK_ROWS)
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)
                own, distance = found.nearest(x, b.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64))
                for c in np.unique(own).tolist():
                    mine = own == c
                    sums[c, 0] += int(mine.sum())
                    sums[c, 1:] += x[mine].sum(0)
                    inertia[c] += sum(distance[mine].tolist())
                n = b.num_rows
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), pa.nulls(n, pa.list_(pa.int32())) if last else b.column("x").cast(pa.list_(pa.int32())), pa.array(own.astype(np.int32)), pa.array(distance),
                     pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.decimal128(38, 0)), pa.array(np.zeros(n, np.int32))],
                    names=schema.names,
                )
        full = np.flatnonzero(sums[:, 0])
        if len(full):
            n = len(full)
            total = pa.array([inertia[c] for c in full], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, kind), pa.nulls(n, pa.list_(pa.int32())), pa.array(full.astype(np.int32)), pa.nulls(n, pa.int64()), pa.array(sums[full].tolist(), pa.list_(pa.int64())), total, pa.array(np.ones(n, np.int32))],
                names=schema.names,
            )

    path = new_path(spark, "clusters")
    rows.mapInArrow(assign, schema).write.partitionBy("part").parquet(path)
    return path


def _read(rows: DataFrame, path: str, part: int) -> DataFrame:
    key = rows.schema["id"].dataType.simpleString()
    schema = f"id {key}, x array<int>, cluster int, distance long, sums array<long>, inertia decimal(38,0), part int"
    return rows.sparkSession.read.schema(schema).parquet(path).where(F.col("part") == part)


def _moved(centres: np.ndarray, totals: DataFrame) -> np.ndarray:
    """Centroids as the exact floors of their vectors' means; one without vectors stays."""
    parts = totals.select("cluster", F.posexplode("sums")).groupBy("cluster", "pos").agg(F.sum(F.col("col").cast("decimal(20,0)")).alias("total"))
    found = {(r["cluster"], r["pos"]): int(r["total"]) for r in parts.collect()}
    out = centres.copy()
    for c in range(len(centres)):
        if n := found.get((c, 0)):
            out[c] = [found[c, i + 1] // n for i in range(centres.shape[1])]
    return out


def cluster(vectors: DataFrame, p: Params = Params(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per usable vector: key, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Usable are vectors of exactly `width` components, none null or non-finite; others, and null or empty ones, have no
    row. Components beyond `peak` after scaling count as `peak`. Equal rows are vectors of their own; equal keys share
    a hash and are drawn in the order of their vectors, null keys last. Fewer vectors than clusters make fewer clusters; an
    empty table gives no rows. Equally near centroids: the smaller number. Sums beyond a long are given as the
    greatest long. Columns beside key and vector may have any name and are not kept.
    """
    spark = vectors.sparkSession
    rows = integers(vectors, p, key, vector)
    centres = first_centroids(rows, p)
    state, held = rows.withColumn("cluster", F.lit(0)), None
    if len(centres):
        for step in range(p.rounds + 1):
            last = step == p.rounds
            path = _round(state.select("id", "x", "cluster"), centres, last)
            if held:
                discard(spark, held)
            state, held = _read(rows, path, 0), path
            totals = _read(rows, path, 1)
            if not last:
                centres = _moved(centres, totals)
        inertia = {r["cluster"]: int(r["total"]) for r in totals.groupBy("cluster").agg(F.sum("inertia").alias("total")).collect()}
    else:
        state, inertia = state.withColumn("distance", F.lit(0).cast("long")), {}
    whole = min(sum(inertia.values()), LONGEST)
    heads = [(c, min(inertia.get(c, 0), LONGEST), whole, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centres.tolist())]
    heads = spark.createDataFrame(heads, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # one row for each of `clusters` centroids
    return state.select(F.col("id").alias(key), "cluster", "distance").join(F.broadcast(heads), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

"""Sort-means against comparing every vector with every centroid."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from sparkveil.llm import clustering
from sparkveil.llm.queries import op11_clusters

SCHEMA = "vec_id long, embedding array<double>, cluster string, x int, `a.b` string"


def brute(rows, p):
    """All rows (key, vector) by the definition, in plain Python."""
    kept = [(k, [max(-p.peak, min(p.peak, math.floor(p.scale * c))) for c in v]) for k, v in rows if v is not None and len(v) == p.width and all(c is not None and math.isfinite(c) for c in v)]
    drawn = lambda r: (r[0] is None, hashlib.sha256(f"{p.salt}:{r[0]}".encode()).hexdigest(), r[1])
    centres = [x for _, x in sorted(kept, key=drawn)[: p.clusters]]
    apart = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    assign = lambda: [min((apart(x, c), j) for j, c in enumerate(centres)) for _, x in kept]
    for _ in range(p.rounds):
        own = assign()
        for j in range(len(centres)):
            mine = [x for (_, x), (_, o) in zip(kept, own, strict=True) if o == j]
            if mine:
                centres[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    own = assign()
    inertia = [sum(d for d, o in own if o == j) for j in range(len(centres))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((k, o, d, inertia[o], sum(inertia), digest[o]) for (k, _), (d, o) in zip(kept, own, strict=True)), key=str)


def found(df):
    assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(map(tuple, df.collect()), key=str)


def test_scan_equals_all_distances_with_ties():
    rng = np.random.default_rng(3)
    x = rng.integers(-3, 4, (3000, 3))  # a small lattice: many equal distances
    centres = np.concatenate([rng.integers(-3, 4, (9, 3)), x[:3], x[:3]])
    d = ((x[:, None, :] - centres[None]) ** 2).sum(2)
    for before in (np.zeros(len(x), np.int64), rng.integers(0, len(centres), len(x))):
        own, best = clustering.Centroids(centres).nearest(x, before)
        assert (own == d.argmin(1)).all() and (best == d.min(1)).all()


def test_scan_stops_early():
    class Counted(list):
        seen = 0

        def __iter__(self):
            for j in list.__iter__(self):
                Counted.seen += 1
                yield j

    centres = np.array([[1000 * i, 0] for i in range(16)])
    c = clustering.Centroids(centres)
    c.order = [Counted(o) for o in c.order]
    own, _ = c.nearest(centres + 1, np.arange(16))
    assert (own == np.arange(16)).all() and Counted.seen == 16  # one look each, of fifteen


@pytest.mark.parametrize("scale", [64, 2])
def test_clusters_equal_brute_force(spark, scale):
    rng = np.random.default_rng(scale)
    p = clustering.Params(width=4, scale=scale)
    rows = [(i, [float(c) for c in rng.normal(size=4)]) for i in range(400)]
    rows += [(1000 + i, [0.5, -0.5, 0.25, 0.0]) for i in range(200)] + rows[:20]  # copies and repeated rows
    rows += [(1, None), (2, []), (3, [1.0] * 3), (4, [1.0] * 5), (5, [1.0, None, 2.0, 3.0]), (6, [1.0, math.nan, 2.0, 3.0]), (7, [1.0, math.inf, 2.0, 3.0])]
    rows += [(None, [9.0, 9.0, 9.0, 9.0]), (9000, [-0.0, 1e-300, -1e-300, 0.0]), (9001, [1e300, -1e300, 3e6, 0.0])]
    df = spark.createDataFrame([(k, v, "c", 1, "d") for k, v in rows], SCHEMA).repartition(5)
    assert found(clustering.cluster(df, p)) == brute(rows, p)


def test_few_and_no_vectors(spark):
    p = clustering.Params(width=2)
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-4.0, 2.0])]
    assert found(clustering.cluster(spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA), p)) == brute(rows, p)
    for none in ([], [(1, None)], [(1, [1.0])]):
        assert found(clustering.cluster(spark.createDataFrame([(*r, None, None, None) for r in none], SCHEMA), p)) == []


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert found(op11_clusters(spark, sf_dir)) == brute(rows, clustering.Params())

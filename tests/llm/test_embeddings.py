from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sparkveil.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, unit string"


def brute(rows, threshold=0.93):
    ok = [r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(rows):
        for j in range(i + 1, len(rows)):
            b = rows[j]
            if ok[i] and ok[j] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0], links[i], least[find(i)], r[0] == least[find(i)]) for i, r in enumerate(rows))


def test_edges(spark):
    rows = [
        (1, [1.0, 0.0], 1, ""), (2, [2.0, 0.0], 1, ""), (3, [1.0, 0.1], 1, ""), (4, [1.0, 0.0], 2, ""), (5, [0.0, 0.0], 1, ""), (6, None, 1, ""), (7, [1.0, None], 1, ""), (8, [math.nan, 1.0], 1, ""),
        (9, [1.0, 0.0], None, ""), (10, [1.0, 0.0, 0.0], 1, ""), (11, [math.inf, 1.0], 1, ""), (12, [1.0, 0.0], 1, ""), (12, [1.0, 0.0], 1, ""), (13, [-1.0, 0.0], 1, ""), (14, [], 1, ""), (15, [0.0, -0.0], 1, ""),
    ]
    got = sorted(map(tuple, embeddings.link(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == brute(rows)
    assert embeddings.link(spark.createDataFrame(rows, SCHEMA).limit(0)).count() == 0
    unusable = embeddings.link(spark.createDataFrame([(1, None, 1, ""), (2, [0.0], 1, "")], SCHEMA)).collect()
    assert sorted(map(tuple, unusable)) == [(1, 0, 1, True), (2, 0, 2, True)]


@pytest.mark.parametrize("params", [embeddings.Params(list_rows=8, block_rows=16, sample_rows=300), embeddings.Params(list_rows=8, max_lists=2, block_rows=16, crowded_rows=20, refine_rows=64), embeddings.Params()])
def test_recall_against_brute_force(spark, params):
    rng = np.random.default_rng(5)
    rows = []
    for label in range(3):
        base = rng.normal(size=(40, 24))
        for i in range(40):
            for _ in range(1 + 30 * (i == 0) + (i % 3)):
                rows.append((len(rows), [float(x) for x in np.float32(base[i] + rng.normal(scale=0.12, size=24))], label, ""))
    got, expected = sorted(map(tuple, embeddings.link(spark.createDataFrame(rows, SCHEMA), params).collect())), brute(rows)
    assert all(g[1] <= e[1] for g, e in zip(got, expected, strict=True))
    assert sum(g[1] for g in got) >= 0.98 * sum(e[1] for e in expected)
    assert np.mean([g[2] == e[2] for g, e in zip(got, expected, strict=True)]) > 0.97


def test_bound_never_exceeds_distance():
    rng = np.random.default_rng(6)
    x = embeddings.unit(rng.normal(size=(500, 16)))
    index = embeddings.fit(x, 5000, embeddings.Params(codes=8))
    own, codes, error = index.encode(x)
    for at in range(len(index.centres)):
        mine = np.flatnonzero(own == at)
        bound = index.distances(x[:50], at, codes[mine]) - error[mine]
        assert (bound <= np.linalg.norm(x[:50, None] - x[None, mine], axis=2) + 1e-9).all()


def test_every_link_of_low_rank_groups(spark):
    rng = np.random.default_rng(8)
    line, plane = rng.normal(size=(2, 64)), rng.normal(size=(3, 64))
    line /= np.linalg.norm(line, axis=1, keepdims=True)
    drift = line[0] + rng.uniform(-2, 2, size=(1000, 1)) * line[1] + rng.normal(scale=0.005, size=(1000, 64))
    groups = [np.concatenate([drift, rng.normal(size=(2000, 64))]), rng.normal(size=(1000, 3)) @ plane]
    rows, expected = [], []
    for label, group in enumerate(groups):
        x = np.float32(group)
        u = embeddings.unit(x.astype(float))
        expected += ((u @ u.T >= 0.93).sum(1) - 1).tolist()
        rows += [(len(rows) + i, [float(c) for c in r], label, "") for i, r in enumerate(x)]
    got = sorted(map(tuple, embeddings.link(spark.createDataFrame(rows, SCHEMA), embeddings.Params(list_rows=32)).collect()))
    kept = sum(g[1] for g in got) / sum(expected)
    assert [g[1] for g in got] == expected, kept


@pytest.mark.parametrize("params", [embeddings.Params(), embeddings.Params(max_lists=8, crowded_rows=2048)])
def test_recall_on_many_clustered_vectors(spark, tmp_path, params):
    rng = np.random.default_rng(9)
    n, centres = 50_000, rng.normal(size=(12_000, 64))
    label = np.where(rng.random(n) < 1 / 3, 0, rng.integers(1, 12, n))
    which = np.where(rng.random(n) < 0.02, 0, rng.integers(0, len(centres), n))
    x = np.float32(centres[which] + rng.normal(scale=0.2, size=(n, 64)))
    unit, expected = embeddings.unit(x.astype(float)), np.zeros(n, np.int64)
    for value in range(12):
        own = np.flatnonzero(label == value)
        for rows in np.array_split(own, 1 + len(own) // 2000):
            expected[rows] = (unit[rows] @ unit[own].T >= 0.93).sum(1) - 1
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": list(x), "label": pa.array(label, pa.int32())}), tmp_path / "v.parquet")
    got = embeddings.link(spark.read.parquet(str(tmp_path / "v.parquet")), params).select("vec_id", "n_links").toPandas().sort_values("vec_id")["n_links"].to_numpy()
    print("recall", got.sum() / expected.sum(), "of", expected.sum() // 2, "links")
    assert expected.sum() > 20_000 and (got == expected).all()


def test_hundreds_of_lengths_take_one_index(spark, monkeypatch):
    """Vectors of 300 lengths, one of which is common: one index, all other lengths in one job, cut into small blocks."""
    fitted = []
    plain = embeddings.fit
    monkeypatch.setattr(embeddings, "fit", lambda sample, rows, p: fitted.append(sample.shape) or plain(sample, rows, p))
    rng = np.random.default_rng(10)
    rows = [(i, (np.ones(2 + i % 300) + rng.normal(scale=0.4, size=2 + i % 300)).tolist(), i % 2, "") for i in range(900)]
    rows += [(1000 + i, (np.ones(5) + rng.normal(scale=0.4, size=5)).tolist(), 1, "") for i in range(120)] + [(2000, [1.0] * 900, 1, "")] * 3
    got = sorted(map(tuple, embeddings.link(spark.createDataFrame(rows, SCHEMA), embeddings.Params(rare_rows=100, block_rows=16)).collect()))
    assert got == brute(rows) and [shape[1] for shape in fitted] == [5]
    got = sorted(map(tuple, embeddings.link(spark.createDataFrame(rows, SCHEMA), embeddings.Params(block_rows=16)).collect()))
    assert got == brute(rows) and len(fitted) == 1

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from sparkveil.llm import simhash
from sparkveil.llm.components import connected_components

SCHEMA = "doc_id long, text string, fp string, row_id int"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(keys, fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, k in enumerate(keys):
        least.setdefault(find(i), []).append(k)
    return [min((k for k in least[find(i)] if k is not None), default=None) for i in range(len(fps))]


def texts(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    out = ["", None, "A", "a", "A b", "a B c", "a b c d", " \t\n", "É é x", "x" * 100_000, "w " * 30_000]
    for _ in range(30):
        base = [rng.choice(words) for _ in range(rng.randrange(20, 200))]
        for _ in range(rng.randrange(1, 5)):
            near = base[:]
            near[rng.randrange(len(near))] = rng.choice(words)
            out.append(" ".join(near))
    return out


def test_fingerprints_and_components(spark):
    found = texts()
    rows = [(i if i != 5 else None, t, "f", 1) for i, t in enumerate(found)] + [(3, found[3], "f", 1)]
    got = simhash.simhash_components(spark.createDataFrame(rows, SCHEMA)).collect()
    fps = [plain_fingerprint(t) for _, t, _, _ in rows]
    expected = [(k, f"{fp:016x}", c) for (k, _, _, _), fp, c in zip(rows, fps, plain_components([r[0] for r in rows], fps), strict=True)]
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == sorted(expected, key=repr)
    assert sum(r.keeper for r in got) == len(set(c for _, _, c in expected))
    assert simhash.simhash_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_drop_keeps_one_row_and_all_columns(spark):
    rows = [(1, "a b c d e", "x", 1), (1, "a b c d e", "y", 2), (2, "a b c d e", "x", 1), (3, "something else entirely here now", "x", 1), (None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 3, None], key=repr)


@pytest.mark.parametrize("block_rows", [16, 4096])
def test_edges_connect_what_brute_force_connects(spark, block_rows):
    """A dense cloud around a few centres, far over the block size."""
    rng = random.Random(8)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            fps.add(centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (1 << 64) - 1)
    fps = sorted(fps)
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    edges = simhash.near_edges(spark.createDataFrame([(x,) for x in signed], "fp long"), block_rows)
    for r in edges.collect():
        assert ((r.u ^ r.v) & (1 << 64) - 1).bit_count() <= 3
    roots = {r.node: r.root for r in connected_components(edges).collect()}
    got, want = {}, {}
    for x, s, c in zip(fps, signed, plain_components(fps, fps), strict=True):
        got.setdefault(roots.get(s, s), set()).add(x)
        want.setdefault(c, set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("width", simhash.WIDTHS)
def test_embedding_bounds_hamming(width):
    rng = random.Random(2)
    field = (1 << width) - 1
    for _ in range(300):
        a, b = rng.getrandbits(64), rng.getrandbits(64)
        counts = [abs((a >> s & field).bit_count() - (b >> s & field).bit_count()) for s in range(0, 64, width)]
        x, y = simhash.embedding(np.array([a, b], np.uint64), width).tolist()
        assert (x ^ y).bit_count() == sum(counts) <= (a ^ b).bit_count()


def test_every_near_pair_meets_in_the_grid(spark):
    """Pairs at each distance up to three, at each level of refinement."""
    rng = random.Random(21)
    pairs = []
    for i in range(600):
        a = rng.getrandbits(64)
        pairs.append((a, a ^ sum(1 << b for b in rng.sample(range(64), 1 + i % 3))))
    signed = lambda x: int(np.uint64(x).view(np.int64))
    rows = simhash.placed(spark.createDataFrame([(signed(x),) for p in pairs for x in p], "fp long"))
    for width in (None, *simhash.WIDTHS[1:]):
        rows = rows if width is None else simhash.refined(rows, width)
        stored, seen = {}, {}
        for r in rows.collect():
            (stored if r.segment < 0 else seen).setdefault(r.fp, set()).add(r.cell)
        for a, b in pairs:
            a, b = signed(a), signed(b)
            assert stored[a] & (stored[b] | seen[b]) or stored[b] & seen[a]


def test_awkward_names_and_rows(spark):
    rows = [(1, "a b c d e", "x", 1), (1, "a b c d e", "y", 2), (None, None, None, None), (4, "q w e r t y", "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, row int").toDF("doc_id", "text", "_simhash_row", "a.b")
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == 3
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(5, 5), (200, 201), (201, 200), (200, 201)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0

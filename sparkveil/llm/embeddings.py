"""Near-duplicate embeddings by product quantisation.

Vectors are compared within their label. Coarse centroids cut the space into inverted lists; a vector's
residual to its centroid is coded by sub-space centroids. Every vector queries its own list and all
lists whose border to its own lies within half a link's greatest length: the distances of two linked
vectors to the border of their lists add up to at most that length, so one of them finds the other. In a list, table look-ups give the query's asymmetric
distance to each code; since each code's reconstruction error is stored, distance less error bounds
the true distance from below, and only what may reach the threshold is ranked again by exact cosine.
The coarse lists are bounded in number, since their centroids reach every task; a list that grows crowded is cut
by centroids of its own, which travel with its rows: a query visits all parts whose border is no further than a
link is long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize
from .components import connected_components


@dataclass(frozen=True)
class Params:
    """threshold: least cosine of a link; list_rows: about how many vectors of a sample a list holds;
    max_lists: coarse lists at most; sample_rows, sample_values: bounds of the sample that centroids are fitted on, in
    vectors and numbers; subspaces, codes: of the product quantiser; block_rows: largest part of a list that one
    task compares at once; crowded_rows: a list of more is cut by centroids of its own, `levels` times at most, fitted
    on about refine_rows of its vectors; rare_rows: vectors of a length that fewer have are compared without an index, all such
    lengths in one job; seed, rounds: of k-means."""

    threshold: float = 0.93
    list_rows: int = 256
    max_lists: int = 1024
    sample_rows: int = 20_000
    sample_values: int = 8_000_000
    subspaces: int = 8
    codes: int = 64
    block_rows: int = 512
    crowded_rows: int = 8192
    refine_rows: int = 4096
    levels: int = 2
    rare_rows: int = 256
    seed: int = 7
    rounds: int = 8


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * x @ centres.T, 0.0)


def _within(d: np.ndarray, own: np.ndarray, gaps: np.ndarray, reach: float) -> np.ndarray:
    """Which lists have a border with the rows' `own` that is no further off than `reach`; d: squared distances to the
    centres, gaps: the centres' distances."""
    border = (d - d[np.arange(len(d)), own][:, None]) / np.maximum(2 * gaps[own], 1e-12)
    near = border <= reach + 1e-6
    near[np.arange(len(d)), own] = True
    return near


def kmeans(x: np.ndarray, k: int, p: Params) -> np.ndarray:
    rng = np.random.default_rng(p.seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(p.rounds):
        own = _nearest(x, centres).argmin(1)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
    return centres


@dataclass(frozen=True)
class Index:
    """Coarse centroids and sub-space code books for vectors of one dimension."""

    centres: np.ndarray
    books: list[np.ndarray]
    cuts: list[int]
    radius: float
    gaps: np.ndarray

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, reconstruction error) of unit rows."""
        own = _nearest(x, self.centres).argmin(1)
        rest = x - self.centres[own]
        codes = np.zeros((len(x), len(self.books)), np.uint8)
        error = np.zeros(len(x))
        for j, book in enumerate(self.books):
            d = _nearest(rest[:, self.cuts[j] : self.cuts[j + 1]], book)
            codes[:, j] = d.argmin(1)
            error += d.min(1)
        return own, codes, np.sqrt(error)

    def probes(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """For unit rows in lists `own`, which lists they query."""
        return _within(_nearest(x, self.centres), own, self.gaps, self.radius / 2)

    def distances(self, q: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of unit rows `q` to the codes of list `at`, by table look-up."""
        rest = q - self.centres[at]
        total = np.zeros((len(q), len(codes)))
        for j, book in enumerate(self.books):
            total += _nearest(rest[:, self.cuts[j] : self.cuts[j + 1]], book)[:, codes[:, j]]
        return np.sqrt(total)


def fit(sample: np.ndarray, rows: int, p: Params) -> Index:
    """Centroids from the unit rows of a bounded sample, for an index of `rows` vectors."""
    width = sample.shape[1]
    lists = max(1, min(p.max_lists, rows // p.list_rows, len(sample) // 8))
    centres = kmeans(sample, lists, p)
    rest = sample - centres[_nearest(sample, centres).argmin(1)]
    parts = min(p.subspaces, width)
    cuts = [round(i * width / parts) for i in range(parts + 1)]
    books = [kmeans(rest[:, a:b], min(p.codes, len(sample)), p) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    radius = math.sqrt(2 - 2 * p.threshold)
    return Index(centres, books, cuts, radius, np.sqrt(_nearest(centres, centres)))


def unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.sqrt((raw * raw).sum(1, keepdims=True))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def link(vectors: DataFrame, p: Params = Params(), key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector: key, n_links, component_id, kept.

    Links join vectors of equal, non-null labels and equal length with cosine >= threshold in double
    precision. Vectors that are null, empty, zero or hold null or non-finite components, and those
    without a label, link with nothing and are their own component. Equal vectors of a label are one
    class with a count, compared once. component_id is the smallest key reachable; kept says that it is
    the row's own. Repeated rows are vectors of their own: they count as each other's links. A null key
    never names a component unless it stands alone; it is not kept. An empty table gives no rows. Columns beside the three may have
    any name and are not kept.
    """
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.col("label").isNotNull() & v.isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("v"))
    good = rows.where(usable)
    classes = good.groupBy("label", "v").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    classes = materialize(classes.withColumns({"class": F.monotonically_increasing_id(), "width": F.size("v")}), "vector-classes")
    widths = classes.groupBy("width").count()
    common = widths.where(F.col("count") >= p.rare_rows).collect()  # each an index of its own, and rows enough to be worth it
    parts = [_links_of(classes.where(F.col("width") == width), width, n, p) for width, n in common]
    rare = classes.where(~F.col("width").isin([width for width, _ in common]))
    if rare.take(1):
        parts.append(_links_of_rare(rare, p))
    found = reduce(DataFrame.union, parts) if parts else None
    if found is None:
        ranked = classes.select("label", "v", (F.col("copies") - 1).alias("n_links"), F.col("least").alias("component_id"))
    else:
        found = materialize(found, "vector-links")
        counts = found.where("v IS NULL").groupBy("u").agg(F.sum("n").alias("n"))
        roots = connected_components(found.where("v IS NOT NULL").select("u", "v"))
        named = (
            classes.join(counts, classes["class"] == counts["u"], "left").join(roots, classes["class"] == roots["node"], "left")
            .select("label", "v", "least", "copies", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "class").alias("root"))
        )
        named = materialize(named, "vector-named")
        tops = named.groupBy("root").agg(F.min("least").alias("component_id"))
        ranked = named.join(materialize(tops, "vector-tops"), "root").select("label", "v", (F.col("n") + F.col("copies") - 1).alias("n_links"), "component_id")
    ranked = materialize(ranked.select("label", F.xxhash64("v").alias("h"), "v", "n_links", "component_id"), "vector-ranked")
    ranked = ranked.select(F.col("label").alias("l2"), F.col("h"), F.col("v").alias("v2"), "n_links", "component_id")
    done = (
        good.withColumn("h1", F.xxhash64("v")).join(ranked, (F.col("h1") == F.col("h")) & (F.col("label") == F.col("l2")) & (F.col("v") == F.col("v2")))
        .select(F.col("id"), "n_links", "component_id")
    )
    alone = rows.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return done.union(alone).select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


CODED = T.StructType([
    T.StructField("class", T.LongType()), T.StructField("label", T.StringType()), T.StructField("copies", T.LongType()), T.StructField("v", T.ArrayType(T.DoubleType())),
    T.StructField("own", T.IntegerType()), T.StructField("codes", T.BinaryType()), T.StructField("error", T.DoubleType()), T.StructField("probes", T.ArrayType(T.IntegerType())),
])
FOUND = "u long, v long, n long"


def _links_of(classes: DataFrame, width: int, n: int, p: Params) -> DataFrame:
    """Of vectors of one length: rows (u, null, n), parts of u's number of links, and edges (u, v, null) that connect what links connect."""
    spark = classes.sparkSession
    sample = classes.orderBy(F.xxhash64("class"), "class").limit(min(p.sample_rows, max(1, p.sample_values // width))).select(F.col("v").cast("array<double>")).toPandas()
    index = fit(unit(np.array(sample["v"].tolist(), dtype=np.float64)), n, p)
    shared = spark.sparkContext.broadcast(index)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                b = whole.slice(start, 2000)
                x = unit(_matrix(b.column("v"), width))
                own, codes, error = ix.encode(x)
                near = ix.probes(x, own)
                bounds = np.concatenate([[0], np.cumsum(near.sum(1))]).astype(np.int32)
                probes = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.nonzero(near)[1].astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c) for c in ("class", "label", "copies", "v")), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), probes],
                    names=CODED.names,
                )

    plain = classes.select("class", F.col("label").cast("string").alias("label"), "copies", F.col("v").cast("array<double>").alias("v"))
    coded = materialize(plain.mapInArrow(code, CODED), "vector-codes")
    cell = F.concat_ws("|", "at", "label").alias("cell")
    entry = coded.select(F.lit(0).alias("role"), F.col("own").alias("at"), *CODED.names[:-1]).select("role", cell, "at", *CODED.names[:-1])
    query = coded.select(F.lit(1).alias("role"), F.explode("probes").alias("at"), *CODED.names[:-1]).select("role", cell, "at", *CODED.names[:-1])
    rows, placed = entry.union(query), None
    for level in range(p.levels + 1):
        sizes = rows.groupBy("cell").agg(F.count_if(F.col("role") == 0).alias("stored"), F.count_if(F.col("role") == 1).alias("asked"))
        sizes = materialize(sizes.where("stored > 0 AND asked > 0"), "vector-cells")
        crowded = F.col("stored") > p.crowded_rows
        last = level == p.levels or not sizes.where(crowded).take(1)
        now = _blocked(rows, sizes if last else sizes.where(~crowded), p)
        placed = now if placed is None else placed.union(now)
        if last:
            break
        rows = materialize(_refined(rows, sizes.where(crowded), width, p), "vector-parts")

    return _compared(placed, shared, p)


def _links_of_rare(classes: DataFrame, p: Params) -> DataFrame:
    """`_links_of` for all lengths that few vectors have: those of a length and label are compared in pairs of blocks."""
    plain = classes.select("class", F.col("label").cast("string").alias("label"), "copies", F.col("v").cast("array<double>").alias("v"), F.lit(0).alias("own"), F.lit(None).cast("binary").alias("codes"), F.lit(0.0).alias("error"))
    rows = plain.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("role"), F.concat_ws("|", F.size("v"), "label").alias("cell"), F.lit(0).alias("at"), *CODED.names[:-1])
    sizes = rows.groupBy("cell").agg(F.count_if(F.col("role") == 0).alias("stored"), F.count_if(F.col("role") == 1).alias("asked"))
    return _compared(_blocked(rows, sizes, p), None, p)


def _compared(placed: DataFrame, shared: Broadcast | None, p: Params) -> DataFrame:
    """What the units of `placed` link, by the index or, without one, by all cosines."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, now, held = shared.value if shared else None, None, []
        unit_of: Unit | None = None
        for name, part in _runs(batches, "unit"):
            if name != now:
                if unit_of:
                    held.append(unit_of.result())
                if sum(len(h[0]) for h in held) > 50_000:
                    yield _found(held)
                    held = []
                now, unit_of = name, Unit(ix, len(part.column("v")[0]), p)
            unit_of.take(part)
        if unit_of:
            held.append(unit_of.result())
        if held:
            yield _found(held)

    return placed.repartition("unit").sortWithinPartitions("unit", "role").mapInArrow(compare, FOUND)


def _blocked(rows: DataFrame, sizes: DataFrame, p: Params) -> DataFrame:
    """The rows of the cells in `sizes`, cut into blocks on both sides; each pair of blocks is a unit of work."""
    parts = lambda n: F.ceil(F.col(n) / p.block_rows).cast("int")
    mine = lambda n: F.pmod(F.xxhash64("class"), F.col(n)).cast("int")
    other = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = rows.join(sizes.select("cell", parts("stored").alias("stored_blocks"), parts("asked").alias("asked_blocks")), "cell")
    placed = (
        held.where("role = 0").withColumn("i", mine("stored_blocks")).withColumn("j", other("asked_blocks"))
        .unionByName(held.where("role = 1").withColumn("j", mine("asked_blocks")).withColumn("i", other("stored_blocks")))
    )
    return placed.select(F.concat_ws(",", "i", "j", "cell").alias("unit"), "role", "at", *CODED.names[:-1])


def _refined(rows: DataFrame, crowded: DataFrame, width: int, p: Params) -> DataFrame:
    """The rows of crowded cells, placed anew by centroids of the cell's own, which are fitted on a bounded part of its
    entries. An entry lies in one part; a query visits all that may hold a vector it links with. Every slice of a
    cell's rows gets the centroids, so that a hot cell spreads."""
    slices = F.ceil((F.col("stored") + F.col("asked")) / p.crowded_rows).cast("int")
    held = rows.join(crowded.withColumn("slices", slices), "cell")
    some = held.where((F.col("role") == 0) & (F.pmod(F.xxhash64("class", F.lit(11)), F.col("stored")) < p.refine_rows))

    def centred(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("class")
        x = unit(np.stack(frame["v"].to_list()))
        centres = kmeans(x, max(2, min(int(frame["stored"].iloc[0]) // p.list_rows, len(x) // 8)), p)
        return pd.DataFrame({"cell": frame["cell"].iloc[0], "class": np.arange(len(centres)), "v": list(centres)})

    heads = materialize(some.select("cell", "class", "stored", "v").groupBy("cell").applyInPandas(centred, "cell string, class long, v array<double>"), "vector-part-centres")
    heads = heads.join(crowded.select("cell", slices.alias("slices")), "cell").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    sliced_rows = held.withColumn("slice", F.pmod(F.xxhash64("class", "role"), F.col("slices")).cast("int"))
    names = ["role", "cell", "at", *CODED.names[:-1]]
    both = sliced_rows.select("slice", *names).unionByName(heads.select("slice", "cell", "class", "v", F.lit(-1).alias("role")), allowMissingColumns=True)
    both = both.select(F.concat_ws(",", "slice", "cell").alias("piece"), *names)
    radius = math.sqrt(2 - 2 * p.threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, centres, gaps = None, [], None, None
        for name, part in _runs(batches, "piece"):
            if name != now:
                now, seen, centres = name, [], None
            first = int(np.searchsorted(part.column("role").to_numpy(), 0))
            if first:
                seen.append(_matrix(part.column("v").slice(0, first), width))
            for start in range(first, part.num_rows, 512):
                b = part.slice(start, min(512, part.num_rows - start)).select(names)
                if not seen:  # no centroids: the cell stays whole
                    yield b
                    continue
                if centres is None:
                    centres = np.concatenate(seen)
                    gaps = np.sqrt(_nearest(centres, centres))
                d = _nearest(unit(_matrix(b.column("v"), width)), centres)
                own = d.argmin(1)
                near = _within(d, own, gaps, radius)
                near[b.column("role").to_numpy() == 0] = False
                near[np.arange(len(d)), own] = True
                at, to = np.nonzero(near)
                taken = b.take(pa.array(at))
                cells = pc.binary_join_element_wise(pa.array(to).cast(pa.string()), taken.column("cell").cast(pa.string()), ":")
                yield pa.RecordBatch.from_arrays([cells if n == "cell" else taken.column(n) for n in names], names=names)

    return both.repartition("piece").sortWithinPartitions("piece", "role", "class").mapInArrow(run, rows.schema)


def _runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Slices of rows with equal `column`, and its value; one value may come in several, one after the other."""
    for whole in batches:
        names = whole.column(column)
        number = names.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if whole.num_rows else []
        for start, stop in zip(starts, [*starts[1:], whole.num_rows], strict=True):
            yield names[int(start)].as_py(), whole.slice(int(start), int(stop - start))


def _found(held: list) -> pa.RecordBatch:
    u, v, n = ([x for h in held for x in h[i]] for i in range(3))
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(n, pa.int64())], names=["u", "v", "n"])


class Unit:
    """One block of a list against one block of its queries, taken in pieces: first all entries, then the
    queries in any number of batches."""

    def __init__(self, index: Index | None, width: int, p: Params) -> None:
        self.index, self.width, self.p = index, width, p
        self.entries: list[pa.RecordBatch] = []
        self.ready = False
        self.links: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def take(self, b: pa.RecordBatch) -> None:
        role = b.column("role").to_numpy()
        split = int(np.searchsorted(role, 1))
        if split:
            self.entries.append(b.slice(0, split))
        if split < b.num_rows:
            if not self.ready:
                self._prepare()
            for start in range(split, b.num_rows, 512):
                self._ask(b.slice(start, min(512, b.num_rows - start)))

    def _prepare(self) -> None:
        self.ready = True
        t = pa.Table.from_batches(self.entries).combine_chunks() if self.entries else None
        self.entries = []
        self.size = t.num_rows if t is not None else 0
        self.part = np.arange(self.size)  # entries that edges connect share a number
        if not self.size:
            return
        c = {n: t.column(n).combine_chunks() for n in ("class", "copies", "v", "codes", "error", "at")}
        c = {n: (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x) for n, x in c.items()}
        self.at = c["at"][0].as_py()
        self.cls, self.copies, self.error = (c[n].to_numpy(zero_copy_only=False) for n in ("class", "copies", "error"))
        self.raw = _matrix(c["v"], self.width)
        self.norm = np.sqrt((self.raw * self.raw).sum(1))
        if self.index:
            self.codes = np.frombuffer(b"".join(c["codes"].to_pylist()), np.uint8).reshape(self.size, -1)
        else:
            self.unit = self.raw / self.norm[:, None]

    def _ask(self, b: pa.RecordBatch) -> None:
        if not self.size:
            return
        raw, cls, copies, own = _matrix(b.column("v"), self.width), *(b.column(n).to_numpy(zero_copy_only=False) for n in ("class", "copies", "own"))
        norm = np.sqrt((raw * raw).sum(1))
        if self.index:
            bound = self.index.distances(raw / norm[:, None], self.at, self.codes) - self.error[None, :]
            q, e = np.nonzero(bound <= self.index.radius + 1e-9)
        else:
            q, e = np.nonzero((raw / norm[:, None]) @ self.unit.T >= self.p.threshold - 1e-9)
        first = (own[q] != self.at) | (cls[q] < self.cls[e])  # within a list each pair once
        q, e = q[first], e[first]
        keep = np.zeros(len(q), bool)
        for s in range(0, len(q), 1 << 16):
            a, c = q[s : s + (1 << 16)], e[s : s + (1 << 16)]
            keep[s : s + (1 << 16)] = np.einsum("ij,ij->i", raw[a], self.raw[c]) / (norm[a] * self.norm[c]) >= self.p.threshold
        q, e = q[keep], e[keep]
        # a pair whose entry probes the query's own list meets there too; the smaller list counts it
        drop = np.zeros(len(q), bool)
        down = np.flatnonzero(own[q] < self.at)
        if len(down):
            x = self.raw[e[down]] / self.norm[e[down]][:, None]
            drop[down] = self.index.probes(x, np.full(len(down), self.at))[np.arange(len(down)), own[q[down]]]
        q, e = q[~drop], e[~drop]
        if not len(q):
            return
        ids = np.concatenate([cls[q], self.cls[e]])
        names, inverse = np.unique(ids, return_inverse=True)
        for name, n in zip(names.tolist(), np.bincount(inverse, np.concatenate([self.copies[e], copies[q]])).tolist(), strict=True):
            self.links[name] = self.links.get(name, 0) + int(n)
        bounds = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1], [True]]))
        for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):  # one query's entries: an edge for each part of the block they lie in
            own_entries = e[a:z]
            parts, first_of = np.unique(self.part[own_entries], return_index=True)
            self.edges += [(int(cls[q[a]]), int(x)) for x in self.cls[own_entries[first_of]]]
            if len(parts) > 1:
                self.part[np.isin(self.part, parts[1:])] = parts[0]

    def result(self) -> tuple[list, list, list]:
        """Columns u, v, n: this unit's share of the link counts, then edges enough to connect what it links."""
        return (
            [*self.links, *(x for x, _ in self.edges)],
            [*([None] * len(self.links)), *(y for _, y in self.edges)],
            [*self.links.values(), *([None] * len(self.edges))],
        )

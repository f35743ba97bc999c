"""SimHash near-duplicates: segment-popcount embedding, grid range join, exact verification.

A fingerprint's embedding counts the set bits of each of its 16 four-bit segments. The Manhattan distance
of two embeddings never exceeds the Hamming distance of the fingerprints. Of two fingerprints within
`RADIUS` = 3 bits, one 32-bit half differs in one bit at most, so the counts of that half's eight segments lie
within Manhattan distance 1. Each half has a grid over these counts, with cells as wide as that radius:
a fingerprint is stored in its own cell and visits those where one count is one higher, which is where any
partner lies that isn't in its own. Cells that many meet in are refined by further segments: the same range
join over counts of two bits, then of one. In a cell, pairs are first held against the Manhattan distance of
the whole embedding, then against the bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, positional, sliced, texts_of
from .components import connected_components

RADIUS = 3
#: Bits of a half, and of a segment at each level of the grid.
HALF, WIDTHS = 32, (4, 2, 1)
#: Columns that the operator adds to documents, whose own are named by position meanwhile.
FP, ROW = "fp", "row"


def fingerprint(text: str) -> int:
    """The 64-bit fingerprint of a text: A-Z lowered, words `[^\\x20\\x09-\\x0D]+`, shingles of three
    words (fewer words: the whole sequence; none: zero), XXH64 with seed 42, and a bit set where over
    half the shingles, repeats included, have it set."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= 3:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts[:-2].tolist(), ends[2:].tolist(), strict=True)]
    found = np.array(hashes, dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for start in range(0, len(found), 4096):  # bounded memory for very long texts
        part = found[start : start + 4096]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(found), bitorder="little")
    return int(bits.view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns `keep` of `docs` (named by position) and FP, the fingerprint as a signed long, and ROW, unique per row. A null text
    counts as empty. Every partition is read once; write the result before using ROW twice."""
    base = docs.select(*dict.fromkeys([*keep, text]))
    schema = T.StructType([*[base.schema[c] for c in keep], T.StructField(FP, T.LongType()), T.StructField(ROW, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, text):
            fps = np.array([fingerprint(t) for t in texts_of(b, text)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(fps), b.column(ROW)], names=[*keep, FP, ROW])

    return base.withColumn(ROW, F.monotonically_increasing_id()).mapInArrow(run, schema)


#: Merges of sorted bits (low positions, distance), by which a segment's set bits move to its low end.
MERGES = {1: (), 2: ((0x5555555555555555, 1),), 4: ((0x5555555555555555, 1), (0x3333333333333333, 2), (0x2222222222222222, 1))}
GRID = "cell long, fp long, half int, segment int"


def embedding(fp: np.ndarray, width: int = WIDTHS[0]) -> np.ndarray:
    """The bit counts of the segments of `width` bits, each in unary in its segment's bits: a count of 3 is
    0111. The Manhattan distance of two embeddings is the number of bits in which these differ."""
    for low, by in MERGES[width]:
        a, b = fp & np.uint64(low), (fp >> np.uint64(by)) & np.uint64(low)
        fp = (fp & np.uint64(((1 << 64) - 1) ^ (low | low << by))) | a | b | ((a & b) << np.uint64(by))
    return fp


def _raised(own: np.ndarray, segment: np.ndarray, width: int) -> np.ndarray:
    """Cells `own` with the count of `segment` one higher; the same where it is full."""
    at = (segment * width).astype(np.uint64)
    return own | ((own << np.uint64(1)) & (np.uint64((1 << width) - 1) << at)) | (np.uint64(1) << at)


def _half_of(counts: np.ndarray, half: np.ndarray) -> np.ndarray:
    return counts & (np.uint64((1 << HALF) - 1) << (half * HALF).astype(np.uint64))


def _grid(cell: np.ndarray, fp: np.ndarray, half: np.ndarray, segment: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(half.astype(np.int32)), pa.array(segment.astype(np.int32))], names=["cell", "fp", "half", "segment"])


def placed(fps: DataFrame) -> DataFrame:
    """The coarsest grid: (cell, fp, half, segment). A row with segment -1 stores the fingerprint in its
    cell, one with another visits the cell where that segment's count is one higher."""
    width = WIDTHS[0]
    # one step for each half: to the own cell and to each neighbour above
    half, segment = (np.array(x) for x in zip(*((h, s) for h in range(64 // HALF) for s in (-1, *range(HALF * h // width, HALF * (h + 1) // width))), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.repeat(b.column("fp").to_numpy().view(np.uint64), len(half))
            h, s = np.tile(half, b.num_rows), np.tile(segment, b.num_rows)
            own = _half_of(embedding(fp, width), h)
            cell = np.where(s < 0, own, _raised(own, np.maximum(s, 0), width))
            there = (s < 0) | (cell != own)
            yield _grid(cell[there], fp[there], h[there], s[there])

    return fps.select("fp").mapInArrow(run, GRID)


def refined(rows: DataFrame, width: int) -> DataFrame:
    """Rows of crowded cells, placed anew within their cells by segments half as wide. A visitor's higher count
    lies in one of the two parts of its segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, fp, half, segment = (b.column(c).to_numpy() for c in ("cell", "fp", "half", "segment"))
            twice = np.flatnonzero(segment >= 0)
            rows = np.concatenate([np.arange(b.num_rows), twice])
            s = np.concatenate([np.where(segment < 0, -1, 2 * segment), 2 * segment[twice] + 1])
            cell, fp, half = cell[rows].view(np.uint64), fp[rows].view(np.uint64), half[rows]
            own = _half_of(embedding(fp, width), half)
            code = np.where(s < 0, own, _raised(own, np.maximum(s, 0), width))
            there = (s < 0) | (code != own)
            with np.errstate(over="ignore"):  # within a cell codes differ, so its parts get cells of their own
                mixed = ((cell ^ (cell >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)) ^ (code * np.uint64(0xC2B2AE3D27D4EB4F))
                mixed ^= mixed >> np.uint64(29)
            yield _grid(mixed[there], fp[there], half[there], s[there])

    return rows.select("cell", "fp", "half", "segment").mapInArrow(run, GRID)


def near_edges(fps: DataFrame, block_rows: int = 4096, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) between the distinct fingerprints `fp` that give every two of them within `radius`
    bits the same component. A cell emits a spanning forest (a small one its few pairs), never all pairs.

    A cell in which over `block_rows` rows meet is refined; one that stays so at the finest level, where
    half the bits are equal but for one, is cut into blocks, and each pair of blocks is a unit of work of
    its own. So no cell has to fit in a task and none is capped.
    """
    if radius > RADIUS:
        raise ValueError(f"one half is only certain to differ in one bit at most up to {RADIUS} bits")
    rows, units = placed(fps), []
    for width in (*WIDTHS[1:], None):
        hot = rows.groupBy("cell").count().where(F.col("count") > block_rows)
        hot = materialize(hot.select("cell", F.ceil(F.col("count") / block_rows).cast("int").alias("blocks")), "hot-cells")
        if not hot.take(1):
            units.append(rows)
            break
        units.append(rows.join(hot, "cell", "left_anti"))
        crowded = rows.join(hot, "cell")
        if width:
            rows = refined(crowded, width)
        else:
            mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks")).cast("int")
            pairs = crowded.withColumn("block", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            units.append(pairs.withColumn("cell", F.xxhash64("cell", F.least("block", "other"), F.greatest("block", "other"))))
    every = units[0].select("cell", "fp", (F.col("segment") >= 0).alias("visits"))
    for more in units[1:]:
        every = every.union(more.select("cell", "fp", (F.col("segment") >= 0).alias("visits")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
        for last, frame in _and_last(frames):
            now = frame["cell"].to_numpy(), frame["fp"].to_numpy().view(np.uint64), frame["visits"].to_numpy().astype(bool)
            cell, fp, visits = (np.concatenate(x) for x in zip(rest, now, strict=True))
            stop = len(cell) if last else int(np.searchsorted(cell, cell[-1])) if len(cell) else 0
            rest = cell[stop:], fp[stop:], visits[stop:]
            yield _forest(cell[:stop], fp[:stop], visits[:stop], radius)

    return every.repartition("cell").sortWithinPartitions("cell", "visits", "fp").mapInPandas(run, "u long, v long").distinct()


def _and_last(frames):
    """Each frame with whether it's the last; an empty last one if there are none."""
    held = None
    for frame in frames:
        if held is not None:
            yield False, held
        held = frame
    yield True, held if held is not None else pd.DataFrame({"cell": np.zeros(0, np.int64), "fp": np.zeros(0, np.int64), "visits": np.zeros(0, bool)})


#: Cells with up to so many pairs to compare are compared together, so many pairs at a time.
SMALL, TOGETHER = 4096, 1 << 20


def _forest(cell: np.ndarray, fp: np.ndarray, visits: np.ndarray, radius: int) -> pd.DataFrame:
    """Edges that connect what pairs within `radius` bits connect, cell by cell. Rows are sorted by cell and
    whether they visit; two visitors are never compared."""
    counts = embedding(fp)
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
    ends = np.concatenate([starts[1:], [len(cell)]]).astype(np.int64)
    stored = np.add.reduceat(~visits, starts).astype(np.int64) if len(cell) else np.zeros(0, np.int64)
    work = stored * (ends - starts)
    us, vs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    some = np.flatnonzero((work > 1) & (work <= SMALL))
    # the pairs of a stored row are it and each row behind it in its cell
    left = np.repeat(starts[some], stored[some]) + np.arange(stored[some].sum()) - np.repeat(np.cumsum(stored[some]) - stored[some], stored[some])
    sizes = np.repeat(ends[some], stored[some]) - left - 1
    upto = np.cumsum(sizes)
    first = 0
    while first < len(left):
        last = max(int(np.searchsorted(upto, (upto[first - 1] if first else 0) + TOGETHER, side="right")), first + 1)
        n, i = sizes[first:last], left[first:last]
        a = np.repeat(i, n)
        b = a + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        near = np.bitwise_count(counts[a] ^ counts[b]) <= radius
        a, b = a[near], b[near]
        near = (np.bitwise_count(fp[a] ^ fp[b]) <= radius) & (fp[a] != fp[b])
        us.append(fp[a[near]])
        vs.append(fp[b[near]])
        first = last
    for c in np.flatnonzero(work > SMALL).tolist():
        s = slice(int(starts[c]), int(ends[c]))
        u, v = _spread(fp[s], counts[s], int(stored[c]), radius)
        us.append(u)
        vs.append(v)
    return pd.DataFrame({"u": np.concatenate(us).view(np.int64), "v": np.concatenate(vs).view(np.int64)})


def _spread(fp: np.ndarray, counts: np.ndarray, stored: int, radius: int, batch: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of one cell, whose first `stored` rows are stored and the others visit: from a stored
    seed, take in all rows that are near, then those near to these, until none is left. Each row is held
    against the rest once, whatever the number of pairs; visitors against stored rows only."""
    rest, guests = np.arange(stored), np.arange(stored, len(fp))
    us: list[np.ndarray] = []
    vs: list[np.ndarray] = []
    front = np.zeros(0, np.int64)

    def take(now: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows of `of` near to one of `now`, the others)."""
        if not len(now) or not len(of):
            return of[:0], of
        near = np.bitwise_count(counts[now, None] ^ counts[None, of]) <= radius
        near &= np.bitwise_count(fp[now, None] ^ fp[None, of]) <= radius
        hit = near.any(axis=0)
        us.append(fp[now[near[:, hit].argmax(axis=0)]])
        vs.append(fp[of[hit]])
        return of[hit], of[~hit]

    while len(front) or len(rest):
        if not len(front):
            front, rest = rest[:1], rest[1:]
        now, front = front[:batch], front[batch:]
        found, rest = take(now, rest)
        also, guests = take(now[now < stored], guests)
        front = np.concatenate([front, found, also])
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def components(printed: DataFrame, key: str) -> DataFrame:
    """`printed` (a written frame with FP, ROW and `key`) with `component_id`, the smallest `key` of the
    row's component, and `keeper`, true for one row of each component (smallest key, then row).

    Copies are counted once: the grid sees distinct fingerprints. Null keys never name a component
    unless all of its keys are null; then component_id is null. An empty table gives no rows.
    """
    rows = printed.select(F.col(key).alias("key"), F.col(FP).alias("fp"), F.col(ROW).alias("row"))
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row"))
    classes = materialize(rows.groupBy("fp").agg(first.alias("first")), "classes")
    roots = connected_components(near_edges(classes.select("fp")))
    rooted = materialize(
        classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted"
    )
    tops = materialize(rooted.groupBy("root").agg(F.min("first").alias("top")), "tops")
    named = materialize(
        rooted.join(tops, "root").select("fp", F.col("top.key").alias("component_id"), F.col("top.row").alias("keeper_row")), "named"
    )
    return rows.join(named, "fp").select("key", "fp", "row", "component_id", (F.col("row") == F.col("keeper_row")).alias("keeper"))


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, fingerprint (16 hex digits), component_id, keeper.

    Null texts count as empty; empty texts share fingerprint zero and are linked like any other.
    Repeated rows each return a row; columns beside key and text may have any name.
    """
    plain, of = positional(docs)
    printed = materialize(with_fingerprints(plain, of[text], [of[key]]), "fingerprints")
    return components(printed, of[key]).select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "keeper")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without all but one row of each component (smallest key, then row); columns, whatever their names, and their order
    stay. Nulls, empty texts and empty tables as in `simhash_components`."""
    plain, of = positional(docs)
    printed = materialize(with_fingerprints(plain, of[text], plain.columns), "fingerprints")
    kept = materialize(components(printed, of[key]).where("keeper").select(F.col("row").alias(ROW)), "kept")
    return printed.join(kept, ROW, "left_semi").select(*plain.columns).toDF(*docs.columns)

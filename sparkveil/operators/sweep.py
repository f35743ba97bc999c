"""Conflicts between overlapping detections, in Arrow batches: the work grows with n log n of a text's spans.

A sweep over the sorted starts, with the running maximum of the ends, parts the spans of all texts of a batch into groups
that overlap. A span alone in its group stays. In a group, spans come best first and ask for free space, which is kept as a
sorted list of gaps in blocks that know their longest gap.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..schemas import DETECTION

BLOCK = 512


class Gaps:
    """The free parts of [start, end)."""

    def __init__(self, start: int, end: int) -> None:
        self.starts, self.ends, self.sizes = [[start]], [[end]], [[end - start]]
        self.first, self.most = [start], [end - start]

    def _at(self, start: int) -> tuple[int, int]:
        """Block and place of the last gap that begins at `start` or before; place -1 if there is none."""
        block = max(bisect_right(self.first, start) - 1, 0)
        return block, (bisect_right(self.starts[block], start) - 1 if self.starts else -1)

    def free(self, start: int, end: int) -> bool:
        if not self.starts:
            return False
        block, i = self._at(start)
        return i >= 0 and end <= self.ends[block][i]

    def longest(self, start: int, end: int) -> tuple[int, int] | None:
        """The longest free part of [start, end), of equal ones the first."""
        best, found = 0, None
        if not self.starts:
            return None
        low, i = self._at(start)
        if i < 0 or self.ends[low][i] <= start:
            i += 1
        high = bisect_left(self.first, end) - 1
        for block in (low, high) if low < high else (low,):
            j = bisect_left(self.starts[block], end)
            i = i if block == low else 0
            if block == high and low < high - 1 and (m := max(self.most[low + 1 : high])) > best:
                k = self.most.index(m, low + 1)
                at = self.sizes[k].index(m)
                best, found = m, (self.starts[k][at], self.ends[k][at])
            for k in (i, j - 1) if j - 1 > i else (i,) if i < j else ():
                if k == j - 1 > i and j - i > 2 and (m := max(self.sizes[block][i + 1 : j - 1])) > best:
                    at = self.sizes[block].index(m, i + 1)
                    best, found = m, (self.starts[block][at], self.ends[block][at])
                a, b = max(self.starts[block][k], start), min(self.ends[block][k], end)
                if b - a > best:
                    best, found = b - a, (a, b)
        return found

    def take(self, start: int, end: int) -> None:
        """Use [start, end), which lies in one gap."""
        block, i = self._at(start)
        left, right = self.starts[block][i], self.ends[block][i]
        parts = [(a, b) for a, b in ((left, start), (end, right)) if a < b]
        self.starts[block][i : i + 1] = [a for a, _ in parts]
        self.ends[block][i : i + 1] = [b for _, b in parts]
        self.sizes[block][i : i + 1] = [b - a for a, b in parts]
        if not self.starts[block]:
            for lists in (self.starts, self.ends, self.sizes, self.first, self.most):
                del lists[block]
            return
        if len(self.starts[block]) > 2 * BLOCK:
            for lists in (self.starts, self.ends, self.sizes):
                lists[block : block + 1] = [lists[block][:BLOCK], lists[block][BLOCK:]]
            self.first.insert(block + 1, self.starts[block + 1][0])
            self.most.insert(block + 1, max(self.sizes[block + 1]))
            self.most[block] = right - left  # so that it is looked up below
        self.first[block] = self.starts[block][0]
        if self.most[block] == right - left:
            self.most[block] = max(self.sizes[block])


def resolved(spans: pa.ListArray, trim: bool, texts: pa.Array | None = None) -> pa.ListArray:
    """Each list's spans without overlaps, by place: the better one of two stays, or the worse one keeps its longest free
    part. Spans that are null or empty go, as do those outside of the text where `texts` has its length; null lists stay."""
    lengths = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
    flat = spans.flatten()
    row = np.repeat(np.arange(len(lengths)), lengths)
    field = lambda name: pc.struct_field(flat, name)
    sound = pc.fill_null(pc.less(field("start"), field("end")), False)
    if texts is not None:
        limit = texts.take(pa.array(row))
        sound = pc.and_(sound, pc.fill_null(pc.and_(pc.greater_equal(field("start"), 0), pc.less_equal(field("end"), limit)), pc.is_null(limit)))
    flat, row = flat.filter(sound), row[sound.to_numpy(zero_copy_only=False)]
    n = len(flat)
    start, end = (field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "end"))
    if n:
        span = int(end.max() - start.min())
        place = start + row * (span + 1)  # texts one after another
        order = np.argsort(place, kind="stable")
        reach = np.maximum.accumulate((place + end - start)[order])
        group = np.zeros(n, np.int64)
        group[order] = np.cumsum(np.concatenate([[False], place[order][1:] >= reach[:-1]]))
        kept = np.bincount(group)[group] == 1
        ranks = pa.table({"group": pa.array(group), "score": pc.negate(field("score")), "length": pa.array(start - end), "start": pa.array(start), "kind": field("entity_type")})
        ranked = pc.sort_indices(ranks.filter(pa.array(~kept)), sort_keys=[(c, "ascending") for c in ranks.column_names]).to_numpy()
        ranked = np.flatnonzero(~kept)[ranked]
        edges = np.flatnonzero(np.concatenate([[True], group[ranked][1:] != group[ranked][:-1], [True]])) if len(ranked) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            some = ranked[a:b]
            gaps = Gaps(int(start[some].min()), int(end[some].max()))
            for i, s, e in zip(some.tolist(), start[some].tolist(), end[some].tolist(), strict=True):
                if trim:
                    part = gaps.longest(s, e)
                else:
                    part = (s, e) if gaps.free(s, e) else None
                if part:
                    kept[i] = True
                    start[i], end[i] = part
                    gaps.take(*part)
        chosen = np.flatnonzero(kept)
        chosen = chosen[np.lexsort((start[chosen], row[chosen]))]
    else:
        chosen = np.zeros(0, np.int64)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(row[chosen], minlength=len(lengths)))]).astype(np.int32)
    made = {"start": pa.array(start[chosen].astype(np.int32)), "end": pa.array(end[chosen].astype(np.int32))}
    values = pa.StructArray.from_arrays([made.get(f.name, pc.struct_field(flat, f.name).take(pa.array(chosen))) for f in DETECTION.fields], names=DETECTION.names)
    return pa.ListArray.from_arrays(pa.array(bounds), values, mask=spans.is_null())


def sweep_frame(df: DataFrame, text: str, spans: str, trim: bool) -> DataFrame:
    """`df` with the arrays of `DETECTION` in `spans` resolved, within the lengths of `text`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(spans)
            made = resolved(b.column(at), trim, pc.utf8_length(b.column(text)))
            yield pa.RecordBatch.from_arrays([made if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return df.mapInArrow(run, df.schema)

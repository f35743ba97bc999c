"""Arrays and long texts in time linear in their size: running state along an array, and texts in pieces.

A fold that appends to an array copies it at every step. `scan` appends within chunks and joins these, so that an element is
copied a bounded number of times.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 64
LEVELS = 2
#: Texts are cut into pieces of so many characters, so that no part of a long one is sought from its beginning.
PIECE = 1024


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(items: Column, zero: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """What `step` emits along an array. From the state so far and an item, it gives the next state and the emitted value of
    type `kind`; a null is not emitted. Null arrays give null."""

    def run(part: Column, state: Column, level: int) -> Column:
        """struct(state, out) after a part of the array."""
        if not level:

            def one(acc: Column, x: Column) -> Column:
                return bind(F.struct(*[c.alias(n) for c, n in zip(step(acc["state"], x), ("state", "made"), strict=True)]), lambda r: F.struct(
                    r["state"].alias("state"), F.when(r["made"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(r["made"]))).alias("out")
                ))

            return F.aggregate(part, F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("out")), one)
        size = CHUNK**level
        starts = F.when(F.size(part) > 0, F.sequence(F.lit(1), F.size(part), F.lit(size))).otherwise(F.array().cast("array<int>"))

        def chunk(acc: Column, at: Column) -> Column:
            return bind(run(F.slice(part, at, F.lit(size)), acc["state"], level - 1), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

        zero = F.struct(state.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return bind(F.aggregate(starts, zero, chunk), lambda r: F.struct(r["state"].alias("state"), F.flatten(r["out"]).alias("out")))

    def whole(x: Column) -> Column:  # short arrays, which most are, need no chunks
        return F.when(F.size(x) <= CHUNK, run(x, zero, 0)["out"]).when(x.isNotNull(), run(x, zero, LEVELS)["out"])

    return bind(items, whole)


def pieces(text: Column) -> Column:
    """A text in parts of `PIECE` characters."""
    return F.when(F.length(text).between(1, PIECE), F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))


def cut(parts: Column, start: Column, end: Column) -> Column:
    """Characters [start, end) of a text given in `pieces`."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")
    return F.when((end > start) & (F.size(parts) == 1), F.substring(F.get(parts, F.lit(0)), start + 1, end - start)).when(end > start, F.substring(F.array_join(F.slice(parts, first + 1, last - first + 1), ""), start % PIECE + 1, end - start)).otherwise("")


def measured(text: Column, measure: Callable[[Column], Column], body: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """`body`, which gets a function from an offset to the measure of the text before it. The measure of a text must be the
    sum of its parts', and that of none 0."""

    def upto(known: Column) -> Callable[[Column], Column]:
        def before(at: Column) -> Column:
            index = F.floor(at / PIECE).cast("int")
            return F.get(known["sums"], index) + measure(F.coalesce(F.substring(F.get(known["parts"], index), F.lit(1), at % PIECE), F.lit("")))

        return before

    def summed(parts: Column) -> Column:
        step = lambda total, part: (total + measure(part), total)
        return F.struct(parts.alias("parts"), scan(F.concat(parts, F.array(F.lit(""))), F.lit(0), step, "int").alias("sums"))

    return bind(bind(pieces(text), summed), lambda known: body(upto(known)))

"""Quality rules: repetition from a suffix array over words.

The suffixes of all texts of a slice are sorted at once by prefix doubling; a suffix never reaches over
its text's end. Neighbours' longest common prefixes tell, for each word, the longest repeated
substring that starts there: the top of the LCP intervals it lies in. The union of those spans is what
maximal repeats cover.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sliced, texts_of
from .words import encoded, owners


@dataclass(frozen=True)
class Params:
    """min_words: shortest repeat that counts; max_covered: greatest share of the words that repeats may
    cover; max_repeat: greatest length of a repeat in words."""

    min_words: int = 6
    max_covered: float = 0.4
    max_repeat: int = 300


SYMBOLS = "#*$%&|<>"


def suffix_array(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of the suffixes of the texts in `words`, each text cut off at its own end. Only
    suffixes that share a first word with another of their text are ordered; lcp[i] belongs to
    order[i-1] and order[i], zero across texts."""
    doc = owners(bounds)
    ends = bounds[1:][doc] if len(doc) else np.zeros(0, np.int64)
    n = len(words)
    _, inverse, counts = np.unique((doc << 32) | words, return_inverse=True, return_counts=True)
    # a rank is one more than the number of smaller suffixes, so that a class can be split in place
    levels = [(np.cumsum(counts) - counts)[inverse] + 1]
    step = 1
    where = np.flatnonzero(counts[inverse] > 1)
    live = where
    while len(live):
        # a suffix that ends after `step` words ranks below all others of its class, and is the only such
        far = live + step
        inside = far < ends[live]
        following = np.zeros(len(live), np.int64)
        following[inside] = levels[-1][far[inside]]
        keys = levels[-1][live] * (n + 2) + following
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        starts = np.flatnonzero(fresh)
        # ranks stay in the order of the classes: the class's rank and the place inside it
        base = levels[-1][live[order]]
        first_of_class = np.concatenate([[True], base[1:] != base[:-1]])
        begin = np.maximum.accumulate(np.where(first_of_class, np.arange(len(order)), 0))
        own = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0)) - begin
        now = levels[-1].copy()
        now[live[order]] = base + own
        levels.append(now)
        counts = np.diff(np.concatenate([starts, [len(order)]]))
        again = np.repeat(counts > 1, counts)
        live = np.sort(live[order][again])
        step *= 2
        if step > n:
            break
    order = where[np.argsort(levels[-1][where], kind="stable")]
    lcp = np.zeros(len(order), np.int64)
    if len(order) > 1:
        a, b = order[:-1].copy(), order[1:].copy()
        same = doc[a] == doc[b]
        length = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            width = 1 << k
            fits = same & (a + width <= ends[order[:-1]]) & (b + width <= ends[order[1:]])
            i = np.flatnonzero(fits)
            i = i[levels[k][a[i]] == levels[k][b[i]]]
            length[i] += width
            a[i] += width
            b[i] += width
        lcp[1:] = length
    return order, lcp


def longest_repeats(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest substring from it that its text holds twice or more
    (overlapping occurrences count)."""
    order, lcp = suffix_array(words, bounds)
    out = np.zeros(len(words), np.int64)
    if len(order):
        out[order] = np.maximum(lcp, np.concatenate([lcp[1:], [0]]))
    return out


def covered(repeats: np.ndarray, min_words: int) -> np.ndarray:
    """Which words lie in a repeat of at least `min_words`: the union of the spans."""
    starts = np.flatnonzero(repeats >= min_words)
    change = np.zeros(len(repeats) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + repeats[starts], -1)
    return np.cumsum(change[:-1]) > 0


def spans(text: str, min_words: int = 6) -> list[tuple[int, int]]:
    """Spans (first word, past the last) of one text that repeats of at least `min_words` cover."""
    words, _, bounds = encoded([text.encode("utf-8", "surrogatepass")])
    inside = covered(longest_repeats(words, bounds), min_words).astype(np.int8)
    edges = np.diff(np.concatenate([[0], inside, [0]]))
    return list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True))


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat")


def measures(texts: list[str], p: Params = Params()) -> dict[str, np.ndarray]:
    """The counts of `COLUMNS` for each text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    words, names, bounds = encoded(raw)
    n = len(texts)
    doc = owners(bounds)
    repeats = longest_repeats(words, bounds)
    sizes = np.array([len(w) - sum(1 for c in w if c & 0xC0 == 0x80) if not w.isascii() else len(w) for w in names], dtype=np.int64)
    per = lambda flags: np.bincount(doc, flags, minlength=n).astype(np.int64)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, doc, repeats)
    symbols = SYMBOLS.encode()
    duplicates = []
    for r in raw:
        lines = [x for x in r.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
        duplicates.append(len(lines) - len(set(lines)))
    return {
        "n_words": np.diff(bounds),
        "word_chars": per(sizes[words]) if len(words) else np.zeros(n, np.int64),
        "n_symbols": np.array([len(r) - len(r.translate(None, symbols)) for r in raw], dtype=np.int64),
        "n_dup_lines": np.array(duplicates, dtype=np.int64),
        "n_repeat_words": per(covered(repeats, 3)),
        "n_covered_words": per(covered(repeats, p.min_words)),
        "longest_repeat": longest,
    }


def repetition(docs: DataFrame, p: Params = Params(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, the counts of `COLUMNS`, base_failed, kept.

    base_failed: under 50 words, or over half of the words in three-word windows found twice or more.
    kept: not base_failed, at most `max_covered` of the words inside repeats of `min_words` or more,
    and no repeat longer than `max_repeat`. Null and empty texts have no words and fail; repeated rows
    repeat; whole texts are read, however long.
    """
    base = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`"))
    schema = T.StructType([base.schema[key], *[T.StructField(c, T.LongType()) for c in COLUMNS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, text, max_bytes=1 << 20):
            m = measures(texts_of(b, text), p)
            yield pa.RecordBatch.from_arrays([b.column(key), *[pa.array(m[c]) for c in COLUMNS]], names=[key, *COLUMNS])

    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    good = (F.col("n_covered_words") <= p.max_covered * F.col("n_words")) & (F.col("longest_repeat") <= p.max_repeat)
    return base.mapInArrow(run, schema).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & good)

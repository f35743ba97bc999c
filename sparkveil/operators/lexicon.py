"""Lexicon hits: phrases of any number of words, from a list or a table, found in texts by an Aho-Corasick automaton.

A text is the lower-cased words of it, one space around each, and so is a phrase; the automaton passes over a text once, however
many phrases there are and however they overlap. A large lexicon is split by its phrases' first words into parts of bounded
size. The driver sends one part after the other and holds one at a time; each is matched in a pass of its own over the texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.words import AMBIGUOUS, LEXICON

WORD = r"[\p{L}\p{N}]+"
#: Phrases and characters that one automaton holds at most; about 60 bytes of memory a character.
PART_PHRASES, PART_CHARS = 200_000, 4_000_000
#: Characters of text in one step.
STEP_CHARS = 1 << 22


def table(spark, lexicon: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(phrase, kind, confidence)."""
    rows = [(p, kind, "low" if p in AMBIGUOUS else "medium") for kind, phrases in (lexicon or LEXICON).items() for p in phrases]
    return spark.createDataFrame(rows, "phrase string, kind string, confidence string")


_built: dict[str, object] = {}


def _automaton(number: str, rows: list[tuple[str, str, str]]):
    """The automaton of a part, built once a worker; only the last one stays."""
    if number not in _built:
        import ahocorasick

        lists: dict[str, list[tuple[str, str]]] = {}
        for phrase, kind, confidence in rows:
            lists.setdefault(phrase, []).append((kind, confidence))
        made = ahocorasick.Automaton()
        for phrase, kinds in lists.items():
            made.add_word(f" {phrase} ", (phrase, kinds))
        made.make_automaton()
        _built.clear()
        _built[number] = made
    return _built[number]


def _steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about `STEP_CHARS` of text; one long text alone may be more."""
    sizes = np.array([len(t or "") for t in batch.column("text").to_pylist()], dtype=np.int64)
    step = (np.cumsum(sizes) - sizes) // STEP_CHARS
    edges = np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1], [True]])) if len(step) else []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(int(a), int(b - a))


def hits(df: DataFrame, lexicon: DataFrame, key: str = "doc_id", text: str = "text", part_phrases: int = PART_PHRASES, part_chars: int = PART_CHARS) -> DataFrame:
    """(key, position, phrase, kind, confidence): phrases of the lexicon by the number of the word at which
    they start. A phrase in several lists gives a row for each. Ambiguous ones need a capital letter.

    Case and what stands between words don't count, in texts or phrases; phrases without a word are left out. Null texts have
    no hits. The lexicon is counted, not collected, to find the number of parts; no shuffle of the texts.
    """
    spark = df.sparkSession
    joined = lambda c: F.array_join(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)), " ")
    listed = lexicon.select(F.lower(joined(F.col("phrase"))).alias("phrase"), "kind", "confidence").where("phrase <> ''").distinct()
    n, chars = listed.agg(F.count("*"), F.coalesce(F.sum(F.length("phrase") + 2), F.lit(0))).first()
    parts = max(1, -(-n // part_phrases), -(-chars // part_chars))
    words = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(WORD), F.lit(0))
    rows = df.select(F.col(f"`{key}`").alias("key"), words.alias("words")).where(F.size("words") > 0)
    rows = rows.select("key", F.lower(F.array_join("words", " ")).alias("text"), F.transform("words", lambda w: w.rlike(r"^\p{Lu}")).alias("capital"))
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), *T.StructType.fromDDL("position int, phrase string, kind string, confidence string").fields])
    out = None
    for number in range(parts):
        part = listed if parts == 1 else listed.where(F.pmod(F.xxhash64(F.substring_index("phrase", " ", 1)), F.lit(parts)) == number)
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, [tuple(r) for r in part.collect()]))

        def match(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            if not shared.value[1]:  # an automaton without words can't be asked
                return
            found_by = _automaton(*shared.value)
            for whole in batches:
                for b in _steps(whole):
                    at, positions, made = [], [], []
                    for i, (t, capital) in enumerate(zip(b.column("text").to_pylist(), b.column("capital").to_pylist(), strict=True)):
                        s = f" {t} "
                        found = list(found_by.iter(s))
                        if not found:
                            continue
                        spaces = np.flatnonzero(np.frombuffer(s.encode("utf-32-le"), np.uint32) == 32)
                        starts = np.searchsorted(spaces, [end - len(phrase) - 1 for end, (phrase, _) in found])
                        for word, (_, (phrase, kinds)) in zip(starts.tolist(), found, strict=True):
                            for kind, confidence in kinds:
                                if capital[word] or confidence != "low":
                                    at.append(i)
                                    positions.append(word)
                                    made.append((phrase, kind, confidence))
                    columns = list(zip(*made, strict=True)) or [(), (), ()]
                    yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(at, pa.int64())), pa.array(positions, pa.int32()), *(pa.array(c, pa.string()) for c in columns)], names=schema.names)

        found = rows.mapInArrow(match, schema)
        out = found if out is None else out.union(found)
    return out.withColumnRenamed("key", key)

"""Packing token sequences into windows by best-fit decreasing.

A document is its token ids and an end id. Overlong documents are first cut into full windows; what
remains of each goes, longest first, into the open window with the least room that still holds it,
found in a segment tree over the remaining capacities.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress, islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, sliced
from .words import word_features


@dataclass(frozen=True)
class Params:
    """window: tokens of a sequence; end_id: closes each document; group_pieces: about how many
    remainders are packed together (one group is one task's work); cache_words: words whose ids a
    worker keeps, of `CACHE_BYTES` at most."""

    window: int = 2048
    end_id: int = 1
    group_pieces: int = 32_768
    cache_words: int = 600_000


CACHE_BYTES = 96 << 20
#: What may follow a word of letters without changing how it is encoded: all ASCII punctuation but the apostrophe.
STOPS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Latin letters that are composed already and have one lower case: all but the dotted capital i.
LETTERS = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+$"
_letters = re.compile(LETTERS).match


#: What byte-level models write for bytes that aren't printable in Latin-1: characters from 256 on.
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in {*range(33, 127), *range(161, 173), *range(174, 256)})}


def byte_level(words: list[str]) -> list[str]:
    """Words of letters as byte-level models see them."""
    return "\n".join(words).encode().decode("latin-1").translate(BYTE_LETTERS | {10: 10}).split("\n") if words else []


class WordTokenizer:
    """Ids of whole texts from a tokenizer that drops white space, splits letters from other characters
    and never merges across either: each distinct word is encoded once and remembered, by its place in one array of ids. The result
    equals encoding the whole text."""

    def __init__(self, path: str, cache_words: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.separator = "<|endoftext|>"
        self.separator_id = self.tokenizer.token_to_id(self.separator)
        self.last = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.last[i] = token.endswith("</w>")
        self.cache_words = cache_words
        self.direct = self._is_direct()
        self._forget()

    def _is_direct(self) -> bool:
        """Whether a lower-case word of `LETTERS` goes to the model as its bytes and no added token can lie in it."""
        lower = sorted({c.lower() for c in map(chr, range(0x250)) if _letters(c)})
        return not any(_letters(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) and all(
            self._encode(c).tolist() == [t.id for t in self.model.tokenize(x)] for c, x in zip(lower, byte_level(lower), strict=True)
        )

    def _forget(self) -> None:
        """Words by place: `ids` from `bounds` of the place to the next one, and with `features` their hashed words likewise."""
        self.known: dict[str, int] = {"": 0}
        self.held, self.ids, self.bounds = 0, np.zeros(0, "<u4"), np.zeros(2, np.int64)
        self.bits, self.hashed, self.hashed_bounds = 0, np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn(self, words: list[str]) -> None:
        """Remember the ids of new words, each once."""
        names, ids, sizes = [], [], []

        def keep(part: list[str], found: np.ndarray, ends: np.ndarray, skip: int = 0) -> None:
            """Take the ids up to each end; `skip` ids lie between two words. Unless there is an end for each word, all are encoded alone."""
            if len(ends) != len(part):
                each = [self._encode(w) for w in part]
                found, ends, skip = np.concatenate(each), np.cumsum([len(x) for x in each]), 0
            names.extend(part)
            ids.append(np.delete(found, ends[:-1]) if skip else found)
            sizes.append(np.diff(ends, prepend=-skip) - skip)

        letters = [w for w in words if self.direct and _letters(w)]
        found, ends = array("I"), []
        for w in byte_level(letters):
            found.extend([t.id for t in self.model.tokenize(w)])
            ends.append(len(found))
        keep(letters, np.array(found, dtype="<u4"), np.array(ends, dtype=np.int64))
        others = [w for w in words if not (self.direct and _letters(w))]
        plain = [w for w in others if w.isalpha()]
        for start in range(0, len(plain), 500):  # a run of letters ends with its only word-end piece
            part = plain[start : start + 500]
            found = self._encode(" ".join(part))
            keep(part, found, np.flatnonzero(self.last[found]) + 1)
        mixed = [w for w in others if not w.isalpha() and self.separator not in w]
        for start in range(0, len(mixed), 500):
            part = mixed[start : start + 500]
            found = self._encode(f" {self.separator} ".join(part))
            keep(part, found, np.append(np.flatnonzero(found == self.separator_id), len(found)), 1)
        for w in others:
            if self.separator in w:
                found = self._encode(w)
                keep([w], found, np.array([len(found)]))
        self.known.update(zip(names, range(len(self.known), len(self.known) + len(names)), strict=True))
        self.ids = np.concatenate([self.ids, *ids])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(np.concatenate(sizes))])

    def _found(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.get, words, repeat(-1)), dtype=np.int64, count=len(words))

    def places(self, words: pa.Array) -> np.ndarray:
        """Where the two parts of each of `words` are known (a head and a tail, which is empty for most), until the next call."""
        heads = pc.utf8_rtrim(words, characters=STOPS)
        simple = pc.match_substring_regex(heads, LETTERS)
        cut = pc.and_(simple, pc.not_equal(pc.binary_length(heads), pc.binary_length(words)))
        heads = pc.dictionary_encode(pc.if_else(simple, pc.utf8_lower(heads), words))
        # what stands behind the letters: the word without its leading letters, in ASCII or not
        tails = pc.dictionary_encode(pc.replace_substring_regex(words.filter(cut), f"^[^{re.escape(STOPS)}]+", ""))
        head_words = _strings(heads.dictionary)
        names = head_words + _strings(tails.dictionary)
        found = self._found(names)
        unknown = found < 0
        if unknown.any():
            new = dict.fromkeys(compress(names, unknown.tolist()))
            size = sum(map(len, new))
            if len(self.known) + len(new) > self.cache_words or self.held + size > CACHE_BYTES:
                self._forget()
                new = dict.fromkeys(names)
                new.pop("", None)
                size, unknown = sum(map(len, new)), np.ones(len(names), dtype=bool)
            self.held += size
            self._learn(list(new))
            found[unknown] = self._found(list(compress(names, unknown.tolist())))
        out = np.zeros((len(words), 2), dtype=np.int64)
        out[:, 0] = found[: len(head_words)][_indices(heads)]
        out[cut.to_numpy(zero_copy_only=False), 1] = found[len(head_words) :][_indices(tails)]
        return out

    def features(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The hashed words (`word_features`) of all that is known by place, and the bounds of each place."""
        if bits != self.bits:
            self.bits, self.hashed, self.hashed_bounds = bits, self.hashed[:0], self.hashed_bounds[:1]
        have = len(self.hashed_bounds) - 1
        if have < len(self.known):
            found, sizes = word_features(pa.array(list(islice(self.known, have, None)), pa.string()), bits)
            self.hashed = np.concatenate([self.hashed, found.astype(np.int32)])
            self.hashed_bounds = np.concatenate([self.hashed_bounds, self.hashed_bounds[-1] + np.cumsum(sizes)])
        return self.hashed, self.hashed_bounds

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the bounds of each text."""
        coded, words = split_words(texts)
        parts = self.places(coded.dictionary)[_indices(coded)].ravel()
        starts = self.bounds[parts]
        lengths = self.bounds[parts + 1] - starts
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.ids[np.repeat(starts - ends[:-1], lengths) + np.arange(ends[-1])]
        return ids, ends[::2][words]

    def count(self, places: np.ndarray, coded: pa.DictionaryArray, words: np.ndarray) -> np.ndarray:
        """The number of ids of each text, from `split_words` and the `places` of its dictionary."""
        sizes = (self.bounds[places + 1] - self.bounds[places]).sum(1)
        ends = np.concatenate([[0], np.cumsum(sizes[_indices(coded)])])
        return np.diff(ends[words])


def _indices(coded: pa.DictionaryArray) -> np.ndarray:
    return coded.indices.to_numpy(zero_copy_only=False)


def _strings(words: pa.Array) -> list[str]:
    """As `to_pylist`, without a scalar for each."""
    return words.to_numpy(zero_copy_only=False).tolist()


def split_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The white-space words of all texts (null: none) one after the other, and the bounds of each text in words."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    return pc.dictionary_encode(lists.flatten()), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)


_tokenizers: dict[tuple[str, int], WordTokenizer] = {}


def tokenizer(path: str, cache_words: int) -> WordTokenizer:
    """One per worker process."""
    if (path, cache_words) not in _tokenizers:
        _tokenizers[path, cache_words] = WordTokenizer(path, cache_words)
    return _tokenizers[path, cache_words]


PIECE = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "piece_id")])


def pieces(docs: DataFrame, path: str, p: Params = Params(), key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Every document's full windows and remainder: key, start, length, ids_crc32, doc_tokens and
    piece_id (unique; write the result before using it twice); `with_ids` adds the ids themselves.

    A null text is empty; an empty document is its end id alone.
    """
    base = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("the text"), F.monotonically_increasing_id().alias("_row"))
    text = "the text"
    fields = [base.schema[key], *PIECE.fields, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, end = tokenizer(path, p.cache_words), np.array([p.end_id], dtype="<u4").tobytes()
        number = None
        # with ids a slice and its output lie side by side
        for b in sliced(batches, text, max_bytes=(2 if with_ids else 4) << 20, max_rows=4000):
            if number is None:  # the rows' high bits are the partition's own
                number = b.column("_row")[0].as_py() >> 33 << 33
            at, start, length, crc, total, ids = [], [], [], [], [], []
            encoded, bounds = t.encode(b.column(text))
            for i, (first, past) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                raw = encoded[first:past].tobytes() + end
                n = len(raw) // 4
                for s in range(0, n, p.window):
                    part = raw[4 * s : 4 * (s + p.window)]
                    at.append(i)
                    start.append(s)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(n)
                    if with_ids:
                        ids.append(np.frombuffer(part, dtype="<i4"))
            own = b.column(key).take(pa.array(at, type=pa.int64()))
            columns = [own, *(pa.array(x, type=pa.int64()) for x in (start, length, crc, total)), pa.array(np.arange(number, number + len(at)))]
            number += len(at)
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(ids, type=pa.list_(pa.int32()))] if with_ids else [])], names=[f.name for f in fields])

    return base.mapInArrow(run, T.StructType(fields))


class Capacities:
    """Open windows by remaining capacity, under a segment tree that counts them."""

    def __init__(self, window: int) -> None:
        self.leaves = 1 << window.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.tree[i] += by
            i >>= 1

    def put(self, room: int, window_id: int) -> None:
        if room:
            self.open[room].append(window_id)
            self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The open window with the least room of at least `need`, and its room."""
        tree, i = self.tree, need + self.leaves
        if not tree[i]:
            while i > 1 and (i & 1 or not tree[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i <<= 1
                if not tree[i]:
                    i += 1
        room = i - self.leaves
        self._add(room, -1)
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window id, offset) of each length; `lengths` are at most `window` and come longest first."""
    tree, ids, offsets, used = Capacities(window), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i, n in enumerate(lengths.tolist()):
        found = tree.take(n)
        if found is None:
            room, at = window, used
            used += 1
        else:
            room, at = found
        ids[i], offsets[i] = at, window - room
        tree.put(room - n, at)
    return ids, offsets


def pack(parts: DataFrame, p: Params = Params()) -> DataFrame:
    """`parts` (written pieces) with sequence_id and offset.

    Full windows are sequences of their own and need no packing. Remainders are dealt by hash into
    groups of about `group_pieces`, so a group's size is bounded whatever the input; a group is packed
    in one task, which sees lengths only: the ids are joined to their places. Sequence ids are unique, not dense.
    """
    full = parts.where(F.col("length") == p.window).select("*", (F.col("piece_id") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = parts.where(F.col("length") < p.window)
    groups = max(1, -(-rest.count() // p.group_pieces))
    carried = rest.drop("ids")
    dealt = carried.withColumn("group", F.pmod(F.xxhash64("piece_id"), F.lit(groups)))
    schema = T.StructType([*carried.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "piece_id"], ascending=[False, True], kind="stable")
        ids, offsets = best_fit_decreasing(frame["length"].to_numpy(), p.window)
        return frame.drop(columns="group").assign(sequence_id=(ids * groups + frame["group"].to_numpy()) * 2 + 1, offset=offsets)

    placed = dealt.groupBy("group").applyInPandas(run, schema)
    if "ids" in parts.columns:
        placed = placed.join(rest.select("piece_id", "ids"), "piece_id")
    return full.unionByName(placed)


def pack_documents(docs: DataFrame, path: str, p: Params = Params(), key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place: key, start, length, ids_crc32, doc_tokens,
    sequence_id, offset; with `with_ids` also the piece's ids. Repeated rows are packed each; null keys stay null; null and empty
    texts are their end id; no rows give no rows. Columns beside key and text may have any name."""
    return pack(materialize(pieces(docs, path, p, key, text, with_ids), "pieces"), p).drop("piece_id")


def sequences(packed: DataFrame, p: Params = Params(), pad_id: int = 0) -> DataFrame:
    """The token sequences of `packed` (made with ids): sequence_id, tokens (before padding) and ids,
    padded to the window unless tokens is a power of two. A sequence has at most `window` ids, so a
    group stays small."""
    joined = packed.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    ids = F.flatten(F.col("parts.ids"))
    whole = F.col("tokens").bitwiseAND(F.col("tokens") - 1) == 0
    return joined.select("sequence_id", "tokens", F.when(whole, ids).otherwise(F.concat(ids, F.array_repeat(F.lit(pad_id), (F.lit(p.window) - F.col("tokens")).cast("int")))).alias("ids"))

"""Words of whole texts as hashed integer arrays, computed for a batch at once."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII characters that are neither letters nor digits become spaces.
PUNCTUATION = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: The same, but for line feeds.
LINES = PUNCTUATION[:10] + b"\n" + PUNCTUATION[11:]
#: Odd multipliers that keep the orders of words apart.
FIRST, SECOND, SKIPPED, FINAL = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def encoded(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """White-space words of each text: the word's index among the distinct words, the distinct words,
    and the bounds of each text (one more than there are texts)."""
    lists = [t.split() for t in texts]
    bounds = np.zeros(len(lists) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in lists], out=bounds[1:])
    flat = pa.array([w for x in lists for w in x], type=pa.binary())
    coded = pc.dictionary_encode(flat)
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist(), bounds


def owners(bounds: np.ndarray) -> np.ndarray:
    """For each word, the position of its text."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def scattered(keys: np.ndarray, bits: int) -> np.ndarray:
    """Hash 64-bit keys into [0, 2**bits)."""
    with np.errstate(over="ignore"):
        x = (keys ^ (keys >> np.uint64(31))) * FINAL
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-cased words without punctuation, and the bounds of each text."""
    index, words, bounds = encoded([t.lower().encode("utf-8", "replace").translate(PUNCTUATION) for t in texts])
    return np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words))[index] if words else np.zeros(0, np.uint64), bounds


def word_features(words: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashed words of each string of `words`, which holds no white space, one after the other, and how many each has."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lines = "\n".join(words.to_numpy(zero_copy_only=False).tolist()).lower().encode("utf-8", "replace").translate(LINES)
    flat = lines.split()
    at = np.frombuffer(b"\n" + lines, dtype=np.uint8)
    gap = (at == 32) | (at == 10)
    begins = gap[:-1] & ~gap[1:]
    sizes = np.bincount(np.cumsum(at[1:] == 10)[begins], minlength=len(words))
    h = np.fromiter(map(zlib.crc32, flat), dtype=np.uint64, count=len(flat))
    with np.errstate(over="ignore"):
        return scattered(h * FIRST, bits), sizes


def ngram_features(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words, word pairs and pairs that skip one word: (text position, feature), with repeats."""
    h, bounds = word_hashes(texts)
    doc = owners(bounds)
    with np.errstate(over="ignore"):
        one = scattered(h * FIRST, bits)
        two = scattered(h[:-1] * SECOND + h[1:] * FIRST, bits)[doc[:-1] == doc[1:]]
        skip = scattered(h[:-2] * SKIPPED + h[2:] * FIRST, bits)[doc[:-2] == doc[2:]]
    return (
        np.concatenate([doc, doc[:-1][doc[:-1] == doc[1:]], doc[:-2][doc[:-2] == doc[2:]]]),
        np.concatenate([one, two, skip]),
    )

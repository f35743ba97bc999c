from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkveil.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(PATH)


def odd_texts():
    rng = random.Random(5)
    letters = "aB'sé Éİıσ Σς́ß.,!?;\t\n\x0b\x00 1٣ªﬁǅ中👍🏽‍ll don't"
    out = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(800)]
    return [*out, "<|endoftext|>", "a<|endoftext|>b", "İstanbul. ΣΑΣ, ΑΣ! don't. it's, I'LL'", None, "", "word " * 5000]


@pytest.mark.parametrize("cache", [10, 1_000_000])
def test_words_encode_like_whole_texts(whole, cache):
    t, texts = packing.WordTokenizer(PATH, cache), odd_texts()
    for start in range(0, len(texts), 97):
        part = texts[start : start + 97]
        ids, bounds = t.encode(pa.array(part, pa.string()))
        for x, a, b in zip(part, bounds[:-1], bounds[1:], strict=True):
            assert ids[a:b].tolist() == whole.encode(x or "", add_special_tokens=False).ids


def held(rows, docs, whole, window=2048):
    """Pieces make up their documents, sequences have neither holes nor too many tokens."""
    by, places = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by) == set(docs)
    for k, text in docs.items():
        ids, at = [*whole.encode(text or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(by[k], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    pad = used = 0
    for parts in places.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert 0 < at <= window
        used += at
        pad += 0 if at & (at - 1) == 0 else window - at
    return pad / (pad + used)


def test_query(spark, whole):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack_documents(docs, PATH).collect()
    assert held(rows, {r.doc_id: r.text for r in docs.collect()}, whole) < 0.01


def test_edges(spark, whole):
    rows = [(1, None), (2, ""), (3, "word " * 2047), (4, "word " * 2046), (5, "word " * 9000), (6, "a")]
    docs = spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id long, text string, length int, offset int").repartition(3)
    held(packing.pack_documents(docs, PATH).collect(), dict(rows), whole)
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0
    twice = packing.pack_documents(docs.where("doc_id = 6").union(docs.where("doc_id = 6")), PATH).collect()
    assert len(twice) == 2
    assert packing.pack_documents(docs.select(F.lit(None).cast("long").alias("doc_id"), "text"), PATH).where("doc_id is null").count() > 0


def test_small_groups_and_sequences(spark, whole):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    p = packing.Params(group_pieces=20)
    packed = packing.pack_documents(docs, PATH, p, with_ids=True)
    rows = packed.collect()
    held(rows, {r.doc_id: r.text for r in docs.collect()}, whole)
    made = packing.sequences(packed, p).collect()
    assert {len(r.ids) for r in made if r.tokens & (r.tokens - 1)} <= {2048}
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for r in made:
        assert r.ids[: r.tokens] == [x for piece in sorted(by[r.sequence_id], key=lambda x: x.offset) for x in piece.ids]


def test_best_fit_equals_plain_search():
    rng = random.Random(7)
    for _ in range(20):
        lengths = sorted((rng.randrange(1, 100) for _ in range(300)), reverse=True)
        ids, offsets = packing.best_fit_decreasing(np.array(lengths), 100)
        room: list[int] = []
        for n, i, o in zip(lengths, ids.tolist(), offsets.tolist(), strict=True):
            fitting = [r for r in room if r >= n]
            if fitting:
                assert room[i] == min(fitting)
            else:
                assert i == len(room)
                room.append(100)
            assert o == 100 - room[i]
            room[i] -= n


def test_words_of_letters_go_to_the_model_alone(whole, monkeypatch):
    """Words of Latin letters, whatever punctuation follows, are learned without the whole tokenizer, once for all cases and endings;
    their hashed words are those of the words themselves. A small cache that forgets gives the same."""
    from sparkveil.llm.words import word_features

    letters = [c for c in map(chr, range(0x250)) if packing._letters(c) and packing._letters(c.lower())]
    words = [*letters, *(x + y for x, y in zip(letters, letters[7:])), "Ciónaqueue$$$", "éeuxen,***", "ZÖTZ|<>", "zötz", "zötz.", 'zötz"}']
    t = packing.WordTokenizer(PATH, 1_000_000)
    assert t.direct
    encode, texts = t._encode, []
    monkeypatch.setattr(t, "_encode", lambda text: texts.append(text) or encode(text))
    for _ in range(2):
        ids, bounds = t.encode(pa.array(words))
        for w, a, b in zip(words, bounds[:-1], bounds[1:], strict=True):
            assert ids[a:b].tolist() == whole.encode(w, add_special_tokens=False).ids
    assert not any(c.isalpha() for text in texts for c in text.replace(t.separator, ""))  # what follows the letters
    assert len({*t.places(pa.array(words[-4:]))[:, 0].tolist()}) == 1
    monkeypatch.undo()
    words += ["a-b", "don't.", "İstanbul", "(x", "١٣ª"]
    for known in (t, packing.WordTokenizer(PATH, 10)):
        at = known.places(pa.array(words))[:, 0]
        got, bounds = known.features(11)
        plain, sizes = word_features(pa.array(words), 11)
        assert np.concatenate([got[bounds[i] : bounds[i + 1]] for i in at]).tolist() == plain.tolist()
        assert (np.diff(bounds)[at] == sizes).all()

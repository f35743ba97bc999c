from __future__ import annotations

import random
import re

from sparkveil.llm import repetition


def longest(words):
    n, out = len(words), [0] * len(words)
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and words[i + k] == words[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return out


def plain(text, p=repetition.Params()):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    reach = longest(words)
    cover = lambda k: sum(any(reach[j] >= k and j + reach[j] > i for j in range(i + 1)) for i in range(len(words)))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, repeat, covered = len(words), cover(3), cover(p.min_words)
    failed = n < 50 or 100 * repeat > 50 * n
    kept = not failed and covered <= p.max_covered * n and max(reach, default=0) <= p.max_repeat
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeat, covered, max(reach, default=0), failed, kept)


def made():
    rng = random.Random(9)
    out = [None, "", " \n ", "a", "a " * 120, "one line here\n" * 30, "é#|<>&*$% x\n\né#|<>&*$% x", "z" * 5000]
    for _ in range(25):
        words = [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(1, 90))]
        if rng.random() < 0.5:
            words += words[: rng.randrange(1, 40)]
        out.append(rng.choice([" ", "\n", "\t ", "\x0b"]).join(words))
    return out


def test_equals_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(made())] + [(3, "a", "x"), (None, "a b", "x")]
    got = repetition.repetition(spark.createDataFrame(rows, "doc_id long, text string, kept string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((k, *plain(t)) for k, t, _ in rows), key=repr)
    assert repetition.repetition(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_text():
    rng = random.Random(1)
    words = [str(rng.randrange(5000)) for _ in range(30_000)]
    text = " ".join(words + words[1000:1500])
    m = repetition.measures([text])
    assert m["longest_repeat"][0] >= 500 and m["n_words"][0] == 30_500


def test_spans():
    assert repetition.spans("q a b c d e f g x a b c d e f g y") == [(1, 8), (9, 16)]

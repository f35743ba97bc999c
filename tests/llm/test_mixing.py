from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import public_tokenizers
import pytest

from sparkveil.llm import mixing
from tests.llm.test_classifiers import plain_hash, plain_words

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, source string, lang string, topic string"
TWO = {"a": {"x": 0.7, "y": 0.3}, "b": {"u": 0.2, "v": 0.8}}


def plain_rake(mass, codes, goals, keep):
    """The same fit by its conditions: a price for each value, found by bisection, one value after the other;
    a cell's probability is the product of its prices, at most 1."""
    price = [[1.0] * len(g) for g in goals]

    def shares(d, v, f):
        return sum(m * min(1.0, keep * math.prod((f if (e, codes[e][i]) == (d, v) else price[e][codes[e][i]]) for e in range(len(goals)))) for i, m in enumerate(mass) if codes[d][i] == v)

    for _ in range(60):
        for d, goal in enumerate(goals):
            for v, share in enumerate(goal):
                low, high = 1e-9, 1e9
                for _ in range(70):
                    middle = math.sqrt(low * high)
                    low, high = (middle, high) if shares(d, v, middle) < share * keep * sum(mass) else (low, middle)
                price[d][v] = low
    return [min(1.0, keep * math.prod(price[d][codes[d][i]] for d in range(len(goals)))) for i in range(len(mass))]


def test_rake_equals_plain():
    rng = np.random.default_rng(0)
    for seed in range(4):
        codes = [np.repeat([0, 1, 2], 3), np.tile([0, 1, 2], 3)]
        mass = rng.integers(50, 1000, 9).astype(float)
        own = [np.bincount(c, mass) / mass.sum() for c in codes]
        goals = [0.6 * o + 0.4 * rng.dirichlet([3, 3, 3]) for o in own]
        p = mixing.Params(tolerance=1e-7, sweeps=3000)
        got, worst = mixing.rake(mass, codes, goals, p, 0.5)
        assert worst < 1e-6 and np.allclose(got, plain_rake(mass.tolist(), codes, goals, 0.5), rtol=1e-3), seed


def frame(rows):
    return pd.DataFrame(rows, columns=["in_a", "in_b", "mass"])


def test_calibration_meets_the_targets_or_keeps_less():
    p = mixing.Params(targets=TWO, keep=0.6, tolerance=1e-5)
    free = mixing.calibrate(frame([("x", "u", 100), ("x", "v", 400), ("y", "u", 90), ("y", "v", 160)]), TWO, p)
    scarce = mixing.calibrate(frame([("x", "u", 10), ("x", "v", 200), ("y", "u", 400), ("y", "v", 400)]), TWO, p)
    for out, kept in ((free, 0.6), (scarce, None)):
        share = (out["mass"] * out["probability"]).sum() / out["mass"].sum()
        assert out["probability"].max() <= 1 and (kept is None or np.isclose(share, kept))
        assert np.allclose(out["a_wanted"], out["a_achieved"], atol=1e-4) and np.allclose(out["b_wanted"], out["b_achieved"], atol=1e-4)
        assert out.groupby("in_a")["a_wanted"].first().to_dict() == pytest.approx({"x": 0.7, "y": 0.3})
    assert 0.2 < (scarce["mass"] * scarce["probability"]).sum() / scarce["mass"].sum() < 210 / 1010 / 0.7 + 1e-6
    beyond = mixing.calibrate(frame([("x", "u", 1), ("y", "v", 1000)]), TWO, p)
    assert beyond["probability"].max() <= 1 and beyond["a_achieved"].max() > beyond["a_wanted"].max()  # out of reach, and shown to be
    assert len(mixing.calibrate(frame([]), TWO, p)) == 0


def test_values_without_mass_and_without_target():
    p = mixing.Params(targets=TWO, keep=0.5, tolerance=1e-6)
    out = mixing.calibrate(frame([("x", "u", 300), ("x", "other", 100), ("other", "u", 100), ("other", "v", 500)]), TWO, p)
    goals = {d: dict(zip(out[f"in_{d}"], out[f"{d}_wanted"], strict=True)) for d in "ab"}
    assert goals["a"] == pytest.approx({"x": 0.4, "other": 0.6}) and goals["b"] == pytest.approx({"u": 0.9 * 0.2, "v": 0.9 * 0.8, "other": 0.1})


def test_topics_part_what_is_about_different_things():
    rng = np.random.default_rng(4)
    texts, about, langs = [], [], []
    for i in range(400):
        theme, lang = i % 3, "en" if i % 2 else "de"
        words = [f"{lang}{w}" for w in rng.integers(0, 40, 60)] + [f"theme{theme}x{w}" for w in rng.integers(0, 12, 25)]
        texts.append(" ".join(rng.permutation(words)))
        about.append(theme)
        langs.append(lang)
    p = mixing.Params(topics=3)
    t = mixing.cluster(mixing.word_counts(texts, p.topic_bits), langs, p)
    table = pd.crosstab(np.array(about), np.array(t.assign(texts, langs)))
    assert (table.max(axis=1) / table.sum(axis=1) > 0.95).all() and table.shape == (3, 3)
    assert np.isclose(t.share.sum(), 1) and t.assign(["", " \n"], ["en", "xx"]) == ["other", "other"]


def test_query_equals_plain(spark):
    """Every column of every document, from the tokenizer itself, word loops and the plain raking."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    p = mixing.Params()
    got = {r.doc_id: r for r in mixing.weigh(docs, PATH, p).collect()}
    rows = {r.doc_id: r for r in docs.collect()}
    assert len(got) == len(rows) == docs.count()
    tokenizer, topics = Tokenizer.from_file(PATH), mixing.fit_topics(docs, p, "doc_id", "text", "lang")
    mass = {d: [] for d in ("cell", "tokens")}
    for i, r in rows.items():
        g = got[i]
        assert g.tokens == len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1
        words = plain_words(r.text)
        scores = np.mean([topics.weight[plain_hash(h, p.topic_bits)] for h in words], axis=0) - topics.offset[topics.langs[r.lang]] if words else None
        best = "other" if scores is None else g.topic_group
        assert g.topic_group == best and (scores is None or scores[int(best[5:])] >= scores.max() - 1e-12)
        assert (g.source_group, g.lang_group) == (r.source, r.lang)
        assert g.sampled == (int(hashlib.md5(f"{i}:{p.salt}".encode()).hexdigest()[:8], 16) / 2**32 < g.probability)
        mass["cell"].append((g.source_group, g.lang_group, g.topic_group))
        mass["tokens"].append(g.tokens)
    kept = sum(g.tokens * g.probability for g in got.values())
    for d in ("source", "lang", "topic"):
        for v in {g[f"{d}_group"] for g in got.values()}:
            own = [g for g in got.values() if g[f"{d}_group"] == v]
            share = sum(g.tokens * g.probability for g in own) / kept
            assert np.isclose(share, own[0][f"{d}_achieved"]) and abs(share - own[0][f"{d}_wanted"]) < 2e-3
    for v, share in p.targets["source"].items():
        assert abs(next(g for g in got.values() if g.source_group == v).source_wanted - share) < 1e-3


def test_edges(spark):
    rows = [(1, None, "src0", "en", "t"), (2, "", None, None, None), (3, "a b", "unknown", "xx", "t"), (4, "w | " * 30_000, "src1", "de", "t"), (None, "a b c", "src0", "en", "t"), (1, None, "src0", "en", "t"), (5, "***# " * 9, "src1", "fr", "t"), (6, "LOUD NOISE", "src2", "es", "t")]
    docs = spark.createDataFrame(rows, SCHEMA).toDF("doc_id", "text", "source", "lang", "_mix_source")
    got = mixing.weigh(docs, PATH).collect()
    out = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert (out[3].source_group, out[3].lang_group) == ("other", "other") and (out[1].tokens, out[1].topic_group) == (1, "other")
    assert (out[2].source_group, out[2].tokens) == ("other", 1) and out[4].tokens == 60_001
    kept = mixing.mix(docs.withColumn("a.b", docs.doc_id), PATH)
    assert kept.columns == [*docs.columns, "a.b"]
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r.doc_id for r in got if r.sampled), key=repr)
    assert mixing.mix(docs.limit(0), PATH).count() == 0 == mixing.weigh(docs.limit(0), PATH).count()
    with pytest.raises(ValueError):
        mixing.weigh(docs, PATH, mixing.Params(max_cells=10))


def test_topics_are_fitted_on_every_document(spark):
    """The fit over Spark equals the one in memory over all texts, however they are spread; a theme that only few documents
    hold has its topic, and copies and null keys count."""
    rng = np.random.default_rng(5)
    texts = [" ".join([f"w{w}" for w in rng.integers(0, 40, 30)] + [f"theme{int(i >= 2400)}x{w}" for w in rng.integers(0, 12, 20)]) for i in range(2600)]
    langs = [("en", "de", None)[i % 3] for i in range(2600)]
    p = mixing.Params(topics=2)
    rows = [(None if i % 7 == 0 else i // 2, t, lang) for i, (t, lang) in enumerate(zip(texts, langs, strict=True))]
    docs = spark.createDataFrame([*rows, (1, None, "en"), (2, " \n", "de")], "doc_id long, text string, lang string")
    plain = mixing.cluster(mixing.word_counts(texts, p.topic_bits), [v or "other" for v in langs], p)
    for n in (1, 5):
        got = mixing.fit_topics(docs.repartition(n), p, "doc_id", "text", "lang")
        assert np.array_equal(got.share, plain.share) and all(np.array_equal(got.weight[:, i], plain.weight[:, i]) for i in range(2))
    table = pd.crosstab(np.arange(2600) >= 2400, np.array(plain.assign(texts, [v or "other" for v in langs])))
    assert table.shape == (2, 2) and np.isclose(plain.share.min(), 200 / 2600) and np.isclose(got.share.sum(), 1)


def test_passes_read_slices_of_documents(spark):
    """The topics' passes read a row for a slice, not for a document, whatever the words' numbers; what `mix` keeps comes from
    one Python step."""
    texts = ["a b a", None, "w " * 300, "", "v " * 70_000 + "a", " \n", *[f"x{i} y z" for i in range(3000)]]
    docs = spark.createDataFrame([(i, t, "src0", ("en", "xx")[i % 2]) for i, t in enumerate(texts)], "c0 long, c1 string, c2 string, c3 string").coalesce(1)
    p, of = mixing.Params(topics=2), {"source": "c2", "lang": "c3"}
    rows = mixing.worded(docs, of, p, PATH, ["c0"], "c1")
    batches = rows.toArrow().to_batches()
    assert 1 < sum(b.num_rows for b in batches) < 10
    plain, names = mixing.word_counts([t or "" for t in texts], p.topic_bits), mixing.languages(p)
    for some in (False, True):
        at = [i for i in range(len(texts)) if plain[i].any() or not some]
        got = list(mixing.bagged(batches, some=some, entries=1000))
        counts = np.vstack([mixing.tally(bags.spread(np.arange(len(langs)) << p.topic_bits) + bags.at, bags.times, len(langs), 1 << p.topic_bits) for bags, langs in got])
        assert len(got) > 5 and np.array_equal(counts, plain[at])
        assert np.concatenate([langs for _, langs in got]).tolist() == [names.index(("en", "other")[i % 2]) for i in at]
    assert [r.c0 for r in mixing.placed(rows, None, p).collect()] == list(range(len(texts)))
    out = mixing.mix(docs.toDF("doc_id", "text", "source", "lang"), PATH, p)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1 and out.count() > 0


def test_sums_travel_in_pieces(spark, monkeypatch):
    """Each pass of the fit hands on rows of whole pieces, however few values a piece has, and none of single values."""
    docs = spark.createDataFrame([(i, f"word{i % 7} word{i % 5} alone{i}", "en") for i in range(60)], "doc_id long, text string, lang string")
    whole = mixing.fit_topics(docs, mixing.Params(), "doc_id", "text", "lang")
    monkeypatch.setattr(mixing, "CHUNK", 1000)
    parts = mixing.fit_topics(docs.repartition(5), mixing.Params(), "doc_id", "text", "lang")
    assert (whole.weight == parts.weight).all() and (whole.offset == parts.offset).all() and (whole.share == parts.share).all()


def test_passes_read_several_files_a_task(spark, monkeypatch):
    """The fit's many passes over few bytes run in a quarter of the tasks that reading would take, or a task for each core."""
    docs = spark.createDataFrame([(i, f"word{i % 7} alone{i}", "en") for i in range(200)], "doc_id long, text string, lang string").repartition(64)
    seen, whole = [], mixing.fit

    def counted(total, names, p):
        rows = next(c.cell_contents for c in total.__closure__ if hasattr(c.cell_contents, "rdd"))
        seen.append(rows.rdd.getNumPartitions())
        return whole(total, names, p)

    monkeypatch.setattr(mixing, "fit", counted)
    monkeypatch.setattr(mixing, "materialize", lambda df, name: df)
    assert mixing.fit_topics(docs, mixing.Params(topic_rounds=1), "doc_id", "text", "lang") is not None
    assert seen == [max(16, min(64, spark.sparkContext.defaultParallelism))]

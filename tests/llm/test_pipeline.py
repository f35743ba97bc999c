"""The pipeline's stages on whole tables and on awkward rows, and the queries that have SQL."""

from __future__ import annotations

import os

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sparkveil.llm import mixing, queries, simhash
from sparkveil.llm.common import shared_dir
from tests.test_queries import TABLES, plain

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    cursor = duck.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    expected = sorted((tuple(plain(v) for _, v in sorted(zip(names, r, strict=True))) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()), key=repr) == expected


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns, before = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if i < 4:
            assert docs.columns == columns and 0 < docs.count() <= before
            before = docs.count()
        if name == "quality":
            good = [i for i, r in labels.items() if r.quality == 1]
            assert sum(i in ids for i in good) > 0.97 * len(good)
            poor = [i for i, r in labels.items() if r.quality == 0]
            assert sum(i in ids for i in poor) < 0.1 * len(poor)
        if name == "near_duplicates":
            printed = simhash.simhash_components(docs).collect()
            assert len({r.component_id for r in printed}) == len(printed)
    assert set(docs.columns) >= {"doc_id", "start", "length", "sequence_id", "offset"}


LONG = "y " * 40_000
AWKWARD = [
    (1, None, None, None, None, "x"), (2, "", "en", "src0", 0, "x"), (None, "hello there", "en", None, 11, "x"), (4, LONG, "xx", "src0", 1, None), (4, LONG, "xx", "src0", 1, None),
    (5, "one plain text of some words", "en", "src0", 1, None), (3, "one plain text of some words", "de", "src1", 1, None), (7, "hello there", "en", None, 11, "x"),
]


@pytest.mark.parametrize("n", [0, len(AWKWARD)])
def test_run_on_awkward_rows(spark, tmp_path, n):
    """Nulls, empties, repeats, ties, a long text, a clashing and a dotted name: the rows of each stage."""
    docs = spark.createDataFrame(AWKWARD[:n], "doc_id long, text string, lang string, source string, n_chars long, _row string").toDF("doc_id", "text", "lang", "source", "n_chars", "fp")
    docs.withColumn("a.b", docs.doc_id).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, rows = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows[name] = docs.collect()
    every = sorted((r[0] for r in AWKWARD[:n]), key=repr)
    ids = {k: sorted((r.doc_id for r in v), key=repr) for k, v in rows.items()}
    assert ids["quality"] == ids["toxicity"] == every
    assert ids["near_duplicates"] == ([1, 3, 4, 7] if n else [])
    weighed = mixing.weigh(spark.read.parquet(str(tmp_path / "near_duplicates")), public_tokenizers.path("word_bpe_49k.json")).collect()
    assert ids["mixing"] == sorted(r.doc_id for r in weighed if r.sampled)
    kept = {r.doc_id: r.text for r in rows["mixing"]}
    end = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, text in kept.items():
        pieces = sorted((r.start, r.ids) for r in rows["packing"] if r.doc_id == i)
        assert [x for _, ids in pieces for x in ids] == [*end.encode(text or "", add_special_tokens=False).ids, 1]
    assert set(ids["packing"]) == set(kept)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in out.collect()) == sorted((r.doc_id, r.start, r.ids_crc32) for r in rows["packing"])


def test_run_leaves_only_its_rows(spark, tmp_path):
    folder = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert len(set(os.listdir(folder)) - before) == 1 and out.count() > 0


def test_all_ten_are_registered():
    names = list(queries.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))

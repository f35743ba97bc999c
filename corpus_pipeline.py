"""The corpus pipeline: quality, toxicity, near-duplicates, mixing, packing.

Each stage takes all rows that the one before kept. Null and empty texts are documents like any other: without
words nothing speaks against them, and they are one another's copies. Repeated rows and ties: of equal or near
texts the row with the smallest doc_id stays (then any one of its repeats; a null id only where there is no
other). Null ids, languages and sources are values without a label or target. Empty tables stay empty. Columns
beside those of documents may have any name; all stages but the last keep them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkveil.llm import mixing, packing, quality, simhash, toxicity
from sparkveil.llm.common import discard, new_path, scratch

TOKENIZER = "word_bpe_49k.json"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal quality classifier selects; all, if no label teaches otherwise."""
    return quality.drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not predict toxic; all, if no label teaches otherwise."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that token shares meet the source, language and topic targets; documents with the
    same id share their fate."""
    return mixing.mix(docs, public_tokenizers.path(TOKENIZER))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their token ids, packed into windows: what has one sequence_id, by offset,
    is a training sequence (`packing.sequences` pads them)."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), with_ids=True)


STAGES = [
    ("quality", keep_quality),
    ("toxicity", keep_harmless),
    ("near_duplicates", keep_distinct),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Learned models, fingerprints and tokenizers have no SQL form; tests hold each stage against a plain one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; each one's rows are written and read again for the next. What a stage
    wrote on its way, and the rows of the stage before, are deleted once its own rows are there."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            discard(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs

"""Rendezvous hashing of stable record keys over weighted shards.

Every shard has a score for a record that depends on the record's key and the shard's number and weight alone: -ln(u) /
weight with u uniform in (0, 1]. The smallest score wins, so that a shard gets its weight's share, and a shard that is
added takes only the records whose smallest score is its own. u is a 32-bit word of an MD5 of the key, four shards to a hash.

Everything is column expressions. Slots are numbered without gathering a shard: records are sorted by ranges that cut through
shards, ids and equal rows alike, numbered within their partition, and shifted by what stands before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, new_path, positional

#: Bytes of a record beside its text.
OVERHEAD = 16
#: Low bits of monotonically_increasing_id that count within a partition.
ROW_BITS = 33
WORDS = 4


def scores(key: Column, weights: Sequence[float]) -> list[Column]:
    """The score of each shard for a record's key, smallest first served. A null key counts as an empty one."""
    if not weights or any(not 0 < w < float("inf") for w in weights):
        raise ValueError("weights must be positive and finite")
    text = F.coalesce(key.cast("string"), F.lit(""))
    hashes = [F.md5(F.concat_ws(":", text, F.lit(str(i)))) for i in range(-(-len(weights) // WORDS))]
    out = []
    for shard, weight in enumerate(weights):
        word = F.conv(F.substring(hashes[shard // WORDS], 1 + 8 * (shard % WORDS), 8), 16, 10).cast("long")
        out.append(-F.ln((word + 1) / F.lit(float(2**32))) / F.lit(float(weight)))
    return out


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a record: its smallest score, of equal ones the smallest number."""
    ranked = [F.struct(s.alias("score"), F.lit(i).alias("shard")) for i, s in enumerate(scores(key, weights))]
    return (F.least(*ranked) if len(ranked) > 1 else ranked[0])["shard"]


def assign(records: DataFrame, weights: Sequence[float], key: str = "doc_id", grown: float | None = None) -> DataFrame:
    """`records` with `shard` and, if one more shard of weight `grown` is asked for, `grown_shard`.

    Keys that are equal share a shard; null keys are one key. No shuffle, one pass. Columns of `records` called shard or
    grown_shard are replaced; all others are kept, whatever their names. Empty tables stay empty.
    """
    plain, to = positional(records)
    ranked = [F.struct(s.alias("score"), F.lit(i).alias("shard")) for i, s in enumerate(scores(F.col(to[key]), [*weights, *([] if grown is None else [grown])]))]
    count = len(weights)
    best = F.least(*ranked[:count]) if count > 1 else ranked[0]
    plain = plain.withColumn("best", best)
    out = {"shard": F.col("best.shard")} | ({} if grown is None else {"grown_shard": F.least("best", ranked[count])["shard"]})
    kept = [c for c in records.columns if c not in out]
    return plain.select(*[F.col(to[c]).alias(c) for c in kept], *[c.alias(n) for n, c in out.items()])


def with_slots(records: DataFrame, order: Sequence[str], shard: str = "shard", slot: str = "slot") -> DataFrame:
    """`records` with `slot`, which counts each shard's records from 0 without gaps, by the columns in `order`; records
    that these don't tell apart come in any order.

    A hot shard, key or row is cut like any other part of the order. Reads `records` once and writes it twice to the shared
    folder; narrow rows, such as keys and sizes, are best. Nulls come first in the order.
    """
    plain, to = positional(records)
    tied = materialize(plain.withColumn("tie", F.monotonically_increasing_id()), "shard-rows")
    by = [to[shard], *(to[c] for c in order), "tie"]
    ranked = tied.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    ranked = materialize(ranked.withColumn("range", F.shiftright("at", ROW_BITS)), "shard-ranges")
    # one row for each partition, and one more for each border between shards
    heads = ranked.groupBy("range", F.col(to[shard]).alias("owner")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("owner").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).select(F.col("range").alias("head"), "owner", "shift")
    heads = materialize(heads, "shard-heads")  # so that the planner knows its size
    numbered = ranked.join(heads, (F.col("range") == F.col("head")) & F.col(to[shard]).eqNullSafe(F.col("owner")))
    return numbered.select(*[F.col(to[c]).alias(c) for c in records.columns if c != slot], (F.col("at") + F.col("shift")).alias(slot))


def shard_documents(docs: DataFrame, weights: Sequence[float] = (1.0,) * 40, grown: float = 1.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes (null: none) plus 16, text_crc32 that of the same bytes. law is `key`: key and
    shards alone decide. slot counts within the shard by key, checksum and size. Repeated rows and equal keys are
    documents of their own in one shard; texts play no part in the choice. Null keys share a shard and come first in it. An
    empty table gives no rows. Columns beside key and text may have any name and are not kept.
    """
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("k"), (F.octet_length(content) + OVERHEAD).cast("long").alias("size"), F.crc32(content).alias("text_crc32"))
    placed = with_slots(assign(rows, weights, "k", grown), ["k", "text_crc32", "size"])
    return placed.select(F.col("k").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, weights: Sequence[float], path: str | None = None, key: str = "doc_id", rows_per_file: int = 1_000_000) -> str:
    """Write `docs` as Parquet, one folder `shard=<number>` for each shard, and return the path. A file holds `rows_per_file`
    rows at most; a shard's rows are dealt to tasks in ranges of the key, so that a hot shard or key is written by many."""
    path = path or new_path(docs.sparkSession, "shards")
    plain, to = positional(assign(docs, weights, key))
    names = [F.col(c).alias(n) for n, c in to.items()]
    dealt = plain.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(to["shard"], to[key], "tie")
    dealt.select(*names).write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)
    return path

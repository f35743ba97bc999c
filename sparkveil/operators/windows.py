"""Sliding windows and sessions of keys that may hold most of the rows: counted in time buckets and stitched at their borders.

No key is ever sorted as a whole. What runs over a key in order is one row for each of its buckets that isn't empty, whose
number time bounds, not the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.times import micros
from .metrics import BUCKET_S, with_previous


def trailing_counts(df: DataFrame, key: str, ts: str, seconds: float, into: str, parts: int = 64) -> DataFrame:
    """`df` with `into`, the rows of the same key from `seconds` before a row's time up to that time, both included.

    A count is the difference of two ranks: rows up to the time, less rows before the window. Rows and window starts meet in
    buckets of a `parts`-th of the window, which number them; sums over the buckets before make these numbers ranks. Equal
    times of a key are counted first, so that they travel as one row. Null keys are one key; a null time has a null count.
    """
    reach = round(seconds * 1_000_000)
    length = max(reach // parts, 1)
    points = df.where(F.col(ts).isNotNull()).groupBy(F.col(key).alias("k"), micros(ts).alias("at")).agg(F.count("*").alias("n"))
    rows = points.select("k", "at", F.col("at").alias("pos"), F.lit(1).alias("sign"), "n")
    starts = points.select("k", "at", (F.col("at") - reach).alias("pos"), F.lit(-1).alias("sign"), F.lit(0).cast("long").alias("n"))
    placed = rows.union(starts).withColumn("bucket", F.floor(F.col("pos") / length))
    inside = W.partitionBy("k", "bucket").orderBy("pos", "sign").rowsBetween(W.unboundedPreceding, 0)  # a window's start comes before the rows of its time
    ranked = placed.withColumn("rank", F.sum("n").over(inside)).alias("l")
    totals = placed.groupBy("k", "bucket").agg(F.sum("n").alias("n"))
    before = totals.select("k", "bucket", F.coalesce(F.sum("n").over(W.partitionBy("k").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before")).alias("r")
    joined = ranked.join(before, F.col("l.k").eqNullSafe(F.col("r.k")) & (F.col("l.bucket") == F.col("r.bucket")))
    counts = joined.groupBy(F.col("l.k").alias("k"), "at").agg(F.sum(F.col("sign") * (F.col("rank") + F.col("before"))).alias("counted")).alias("c")
    out = df.alias("d").join(counts, F.col(f"d.`{key}`").eqNullSafe(F.col("c.k")) & (micros(f"d.`{ts}`") == F.col("c.at")), "left")
    return out.select("d.*", F.col("c.counted").alias(into))


def sessions(df: DataFrame, key: str, ts: str, tie: str, gap_s: float, bucket_s: int = BUCKET_S) -> DataFrame:
    """(key, start, end, n): runs of a key's rows with less than `gap_s` between neighbours; end is `gap_s` after the last.

    Rows are told apart into parts of sessions within buckets; a part that goes on with what the bucket before left open takes
    its start from the latest bucket in which a session began. Rows without a time are in no session; null keys are one key.
    """
    gap = round(gap_s * 1_000_000)
    rows = with_previous(df.where(F.col(ts).isNotNull()).select(F.col(key).alias("k"), F.col(ts).alias("t"), F.col(tie).alias("i")), ["k"], "t", "i", ["t"], bucket_s)
    fresh = F.coalesce(micros("t") - micros("previous_t") >= gap, F.lit(True)).cast("int")
    cut = rows.select("k", "t", "i", fresh.alias("fresh"), F.floor(micros("t") / (bucket_s * 1_000_000)).alias("bucket"))
    counted = cut.withColumn("part", F.sum("fresh").over(W.partitionBy("k", "bucket").orderBy("t", "i")))
    parts = counted.groupBy("k", "bucket", "part").agg(F.min("t").alias("start"), F.max("t").alias("last"), F.count("*").alias("n"))
    opened = parts.groupBy("k", "bucket").agg(F.max(F.when(F.col("part") > 0, F.col("start"))).alias("opened"))
    carried = F.last("opened", ignorenulls=True).over(W.partitionBy("k").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    opened = opened.select("k", "bucket", carried.alias("carried")).alias("r")
    joined = parts.alias("l").join(opened, F.col("l.k").eqNullSafe(F.col("r.k")) & (F.col("l.bucket") == F.col("r.bucket")))
    begun = F.when(F.col("part") > 0, F.col("start")).otherwise(F.col("carried"))
    whole = joined.groupBy(F.col("l.k").alias(key), begun.alias("start")).agg(F.max("last").alias("last"), F.sum("n").alias("n"))
    return whole.select(key, "start", F.timestamp_micros(micros("last") + gap).cast(df.schema[ts].dataType).alias("end"), "n")

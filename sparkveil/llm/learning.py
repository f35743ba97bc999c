"""What the two text classifiers share: folds, bounded training samples, one task that learns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One fifth of the ids is held out of all learning.
FOLDS = 5


def held_out(key: str) -> F.Column:
    """True where crc32(id as text) mod 5 is 0; false for a null id."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % FOLDS == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """At most `rows` labelled documents outside the held-out fold: key, text, label.

    The sample is the labelled ids of `docs` with the smallest hashes, so it doesn't depend on order
    or size of the tables. An id with several labels takes the largest, one with several texts the
    smallest; null ids, labels and texts teach nothing.
    """
    marks = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key)).groupBy(key).agg(F.max(label).alias("label"))
    there = docs.where(F.col(text).isNotNull()).select(key).distinct()
    chosen = marks.join(there, key, "left_semi").orderBy(F.xxhash64(key), key).limit(rows)
    return docs.select(key, text).join(F.broadcast(chosen), key).groupBy(key).agg(F.min(text).alias("text"), F.first("label").alias("label"))

"""Audit logs as JSON lines: reading current, rotated and compressed files, and writing them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import AUDIT_EVENT

CORRUPT = "_corrupt_record"
PREVIEW = 100
PERMISSIVE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])


def log_paths(base: str) -> list[str]:
    """The file, its rotations `.N` and compressed rotations `.N.gz`."""
    return [base, f"{base}.[0-9]*"]


def read_raw(spark: SparkSession, paths: str | list[str], schema: T.StructType = AUDIT_EVENT) -> DataFrame:
    """Parsed lines with `_corrupt_record`, the line itself where it doesn't parse, and `_file`. Blank
    lines are skipped; compression goes by file name."""
    lines = spark.read.text(paths).select(F.col("value"), F.col("_metadata.file_path").alias("_file")).where(F.trim("value") != "")
    parsed = F.from_json("value", _with_corrupt(schema), PERMISSIVE)
    return lines.select(parsed.alias("e"), "_file").select("e.*", "_file")


def read_events(spark: SparkSession, paths: str | list[str], schema: T.StructType = AUDIT_EVENT) -> DataFrame:
    """The lines that parse."""
    return read_raw(spark, paths, schema).where(F.col(CORRUPT).isNull()).drop(CORRUPT, "_file")


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line, value) of all lines, numbered from 1 in their files.

    Lines of a file's block are read in order by one task, so that their ids, which count within the task, tell their places in
    it; blocks are counted, and a running sum over a file's blocks gives each one's first number. Plain files are read in as many
    tasks as they have blocks; compressed ones have one.
    """
    block = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.text(paths).select("value", *block, F.monotonically_increasing_id().alias("id"))
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    blocks = blocks.select("file", "block", (F.coalesce(before, F.lit(0)) + 1 - F.col("first")).alias("shift"))
    return lines.join(blocks, ["file", "block"]).select("file", (F.col("id") + F.col("shift")).alias("line"), "value")


def parse_errors(spark: SparkSession, paths: str | list[str], schema: T.StructType = AUDIT_EVENT) -> DataFrame:
    """(file, line, preview) of the lines that don't parse."""
    lines = numbered_lines(spark, paths).where(F.trim("value") != "")
    bad = lines.where(F.from_json("value", _with_corrupt(schema), PERMISSIVE)[CORRUPT].isNotNull())
    return bad.select("file", "line", F.substring("value", 1, PREVIEW).alias("preview"))


def require_events(spark: SparkSession, paths: str | list[str], schema: T.StructType = AUDIT_EVENT, lines: int = 20) -> None:
    """Raise if none of the first lines that aren't blank is an event, as with logs in a form for people."""
    seen = [r[0] for r in read_raw(spark, paths, schema).select(F.col(CORRUPT).isNull()).limit(lines).collect()]
    if seen and not any(seen):
        raise ValueError(f"{paths}: none of the first {len(seen)} lines is a JSON event; a log written for people can't be queried")


def write_events(events: DataFrame, path: str, ts: str = "timestamp", compress: bool = True) -> None:
    """JSON lines by date: retention drops whole partitions."""
    out = events.withColumn("date", F.to_date(ts)).repartition("date", F.pmod(F.xxhash64(*events.columns[:1]), F.lit(8)))
    out.write.mode("append").partitionBy("date").option("compression", "gzip" if compress else "none").json(path)


def human_lines(events: DataFrame) -> DataFrame:
    """One readable line per event: (line). Not made to be read back."""
    return events.select(F.concat_ws(" ", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), F.concat(F.lit("["), F.upper("severity"), F.lit("]")), "event_type", "message").alias("line"))

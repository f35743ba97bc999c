"""The spans table: one row per identifier found, and the filters and counts built on it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.detect import find_all, identifier_type, line_spans, matches
from ..functions.patterns import BY_NAME, TYPES


def spans_table(df: DataFrame, names: Iterable[str], key: str = "doc_id", text: str = "text", max_bytes: int | None = None, lines: bool = False) -> DataFrame:
    """(key, start, end, matched_text, identifier_type, confidence), one row per span; with `lines` also start_line
    and end_line, the line breaks before each. One scan, no shuffle."""
    t = F.col(text)
    found = find_all(t, names, max_bytes)
    return df.select(F.col(key), F.inline(line_spans(t, found) if lines else found))


def with_any(df: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows that have a span."""
    return df.join(spans, key, "left_semi")


def without_any(df: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows that have none."""
    return df.join(spans, key, "left_anti")


def type_dimension(spark) -> DataFrame:
    """The types and their classes: a table whose size the catalogue fixes."""
    rows = [(t.name, t.domain, *(c in t.classes for c in ("high_risk", "gdpr", "pci", "hipaa")), t.domain == "tokens") for t in TYPES]
    return spark.createDataFrame(rows, "identifier_type string, domain string, high_risk boolean, gdpr boolean, pci boolean, hipaa boolean, secret boolean")


def count_by_type(spans: DataFrame) -> DataFrame:
    return spans.groupBy("identifier_type").agg(F.count("*").alias("n"))


def rollup_report(spans: DataFrame) -> DataFrame:
    """Counts by domain and type with their subtotals; the dimension is broadcast, its size is fixed."""
    joined = spans.join(F.broadcast(type_dimension(spans.sparkSession)), "identifier_type")
    return joined.rollup("domain", "identifier_type").agg(F.count("*").alias("n"))


def scan_stats(scanned: DataFrame, types: str = "pii_types", by: Iterable[str] = ()) -> DataFrame:
    """Of a scanned table (an array of types a text): texts scanned, types found, texts with any, and the share of these.
    Null arrays count as scanned without a find."""
    n = F.coalesce(F.size(F.col(types)), F.lit(0))
    counts = scanned.groupBy(*by).agg(F.count("*").alias("total_scans"), F.coalesce(F.sum(F.greatest(n, F.lit(0))), F.lit(0)).alias("total_found"), F.count_if(n > 0).alias("texts_with_any"))
    return counts.withColumn("share", F.when(F.col("total_scans") > 0, F.col("texts_with_any") / F.col("total_scans")).otherwise(0.0))


def validate_batch(df: DataFrame, value: str, name: str, into: str = "is_valid") -> DataFrame:
    if name not in BY_NAME:
        raise ValueError(f"no identifier type {name!r}")
    return df.withColumn(into, F.coalesce(matches(F.col(value), name), F.lit(False)))


def partition_batch(df: DataFrame, value: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, other rows)."""
    marked = validate_batch(df, value, name, "_valid")
    return marked.where("_valid").drop("_valid"), marked.where("not _valid").drop("_valid")


def classify_batch(df: DataFrame, value: str, preset: str = "all", into: str = "identifier_type") -> DataFrame:
    return df.withColumn(into, identifier_type(F.col(value), preset))

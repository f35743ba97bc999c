"""Appends by day and heads of files."""

from __future__ import annotations

import datetime
import glob
import os
import random

from pyspark.sql import functions as F

from sparkveil.sources import tables

SCHEMA = "id string, timestamp timestamp, v int"


def at(day, hour=0):
    return datetime.datetime(2024, 1, 1, hour) + datetime.timedelta(days=day)


def held(spark, path):
    return sorted((r.id or "", str(r.day), r.v) for r in spark.read.parquet(path).collect())


def append(spark, path, rows):
    tables.append_idempotent(spark, path, spark.createDataFrame(rows, SCHEMA), ts="timestamp")


def test_append_by_day_equals_plain(spark, tmp_path):
    """Small and large batches with repeats, against a set of keys and days."""
    path, rng, there = str(tmp_path / "t"), random.Random(3), {}
    for size in (50, 5, 400, 400, 20):
        rows = [(f"k{k}", at(k % 9, k % 24), k) for k in (rng.randrange(600) for _ in range(size))]
        append(spark, path, rows)
        there |= {(i, str(t.date())): v for i, t, v in rows}
        assert held(spark, path) == sorted((i, d, v) for (i, d), v in there.items())


def test_append_again_changes_nothing(spark, tmp_path):
    path, rows = str(tmp_path / "t"), [("a", at(0), 1), ("a", at(0, 5), 1), ("b", at(1), 2), ("a", at(1), 3), ("c", None, 4)]
    append(spark, path, rows)
    first = held(spark, path)
    append(spark, path, rows)
    assert held(spark, path) == first == [("a", "2024-01-01", 1), ("a", "2024-01-02", 3), ("b", "2024-01-02", 2), ("c", "None", 4)]
    append(spark, path, [])
    assert held(spark, path) == first


def test_other_days_are_not_read(spark, tmp_path):
    """Files of days that the batch lacks are made unreadable."""
    path = str(tmp_path / "t")
    append(spark, path, [(f"k{i}", at(i % 5), i) for i in range(100)])
    for file in glob.glob(f"{path}/day=2024-01-0[1235]/*.parquet"):
        with open(file, "wb") as f:
            f.write(b"no parquet")
        os.unlink(os.path.join(os.path.dirname(file), "." + os.path.basename(file) + ".crc"))
    append(spark, path, [("k3", at(3), 3), ("new", at(3), 7)])
    append(spark, path, [(f"n{i}", at(3), i) for i in range(300)])
    assert spark.read.parquet(f"{path}/day=2024-01-04").count() == 20 + 1 + 300


def scanned(spark, df):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df.collect()
        leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
        return leaf.metrics().apply("numOutputRows").value()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_bloom_filters_refuse_files(spark, tmp_path):
    """Eight files of a day with keys all over: a key's rows come from one."""
    path = str(tmp_path / "t")
    for part in range(8):
        append(spark, path, [(f"{(i * 7919 + part) % 100_003:06d}", at(0), i) for i in range(500)])
    table = spark.read.parquet(path)
    known = spark.createDataFrame([("007922", at(0), 1)], SCHEMA).withColumn("day", F.to_date("timestamp"))
    unknown = known.withColumn("id", F.lit("000000x"))
    found = tables.candidates(table, known)
    assert found.count() == 1 and scanned(spark, tables.candidates(table, known)) == 500
    assert scanned(spark, tables.candidates(table, unknown)) == 0


def test_heads_of_huge_files(spark, tmp_path):
    """A sparse file of 3 GB, more than a binary value can hold, in constant memory."""
    with open(tmp_path / "huge file#1.bin", "wb") as f:
        f.write(b"%PDF-1.7")
        f.truncate(3 * 2**30)
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "é.tar").write_bytes(b"\0" * 257 + b"ustar" + b"\0" * 1000)
    df = tables.read_typed_files(spark, str(tmp_path))
    got = {os.path.basename(r.path): (r.length, r.file_type) for r in df.collect()}
    assert got == {"huge file#1.bin": (3 * 2**30, "pdf"), "é.tar": (1262, "tar")}
    assert tables.read_heads(spark, str(tmp_path / "sub"), 3).first()["head"] == bytearray(3)

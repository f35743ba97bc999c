"""Streams return what the same rows return as a batch."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkveil.operators import spans
from sparkveil.operators.metrics import Threshold, alerts
from sparkveil.streaming import pipeline


def drained(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(60)
    finally:
        q.stop()
    return df.sparkSession.table(name)


@pytest.fixture
def events(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(3).write.parquet(str(tmp_path / "e"))
    return e, pipeline.read_stream(spark, str(tmp_path / "e"), e.schema, 1)


def test_scan(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.repartition(2).write.parquet(str(tmp_path / "d"))
    live = pipeline.scan_stream(pipeline.read_stream(spark, str(tmp_path / "d"), docs.schema, 1), ["email", "ip_address"])
    assert sorted(map(tuple, drained(live, "scan").collect())) == sorted(map(tuple, spans.spans_table(docs, ["email", "ip_address"]).collect()))


def test_windowed_counts(events):
    batch, stream = events
    live = drained(pipeline.windowed_counts(stream, "ts", ["event_type"], "1 day", None, "60 days"), "win", "complete")
    expected = batch.groupBy(F.window("ts", "1 day"), "event_type").count()
    assert sorted((r.start, r.event_type, r.n) for r in live.collect()) == sorted((r.window.start, r.event_type, r["count"]) for r in expected.collect())


def test_duplicates(events):
    batch, stream = events
    assert drained(pipeline.deduplicated(stream.union(stream), "event_id", "ts", "60 days"), "dup").count() == batch.count()


def test_thresholds_equal_the_table_form(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [("m", start + timedelta(seconds=30 * i), v) for i, v in enumerate([1.0, 60.0, 70.0, 1.0, 70.0, 95.0, 95.0, 95.0, 95.0, 70.0, 70.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "metric string, ts timestamp, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "m"))
    t = Threshold(60, 90, cooldown_s=60)
    out = drained(pipeline.thresholds(pipeline.read_stream(spark, str(tmp_path / "m"), df.schema), t), "thr").orderBy("ts").collect()
    assert [(r.previous_state, r.state, r.kind) for r in out] == [
        ("normal", "warning", "alert"), ("warning", "normal", "recovery"), ("normal", "warning", "alert"), ("warning", "critical", "alert"), ("critical", "critical", "alert"), ("critical", "warning", "alert"),
        ("warning", "normal", "recovery"),
    ]
    table = alerts(df, "metric", "value", "ts", "value", t).orderBy("ts").collect()
    assert [(r.ts, r.previous_state, r.state, r.kind) for r in table] == [(r.ts, r.previous_state, r.state, r.kind) for r in out]


def test_many_sinks(events, tmp_path):
    batch, stream = events
    seen = {"a": 0, "b": 0}

    def add(name):
        def run(df, _):
            seen[name] += df.count()

        return run

    q = pipeline.to_many(stream, [add("a"), add("b")], str(tmp_path / "cp"), "1 second")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert seen == {"a": batch.count(), "b": batch.count()}


def test_sessions_and_limits_plan(events):
    _, stream = events
    assert pipeline.sessions(stream, "ts", "user_id").isStreaming and pipeline.over_limit(stream, "ts", "user_id", 5).isStreaming

"""Sliding windows, sessions and alerts of hot keys against plain Python, and how they spread."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkveil.operators import metrics, windows
from tests.test_operators import plain_alerts

START = datetime(2024, 1, 1)


def events(spark, rows):
    return spark.createDataFrame([(i, k, None if s is None else START + timedelta(seconds=s), "x") for i, (k, s) in enumerate(rows)], "event_id long, user string, ts timestamp, n string")


def hot(seed, n=1500):
    """Half of the rows under one key; equal times, null keys and null times."""
    rng = random.Random(seed)
    rows = [("hot", rng.randrange(0, 20_000) / 4) for _ in range(n)] + [(rng.choice("abc"), float(rng.randrange(5000))) for _ in range(n)]
    return rows + [(None, 5.0), (None, 5.0), (None, 9000.0), ("a", None)]


@pytest.mark.parametrize(("seconds", "parts"), [(60, 64), (60, 1), (0, 64), (3000, 7), (0.25, 64)])
def test_trailing_counts(spark, seconds, parts):
    rows = hot(1)
    got = {r.event_id: r.c for r in windows.trailing_counts(events(spark, rows), "user", "ts", seconds, "c", parts).collect()}
    for i, (k, s) in enumerate(rows):
        assert got[i] == (None if s is None else sum(1 for q, t in rows if q == k and t is not None and s - seconds <= t <= s)), (i, k, s)
    assert windows.trailing_counts(events(spark, []), "user", "ts", 60, "c").collect() == []


@pytest.mark.parametrize(("gap", "bucket"), [(10, 60), (3, 7), (400, 100), (0.5, 86_400)])
def test_sessions(spark, gap, bucket):
    rows = hot(2)
    want = []
    for key in {k for k, _ in rows}:
        times = sorted(s for k, s in rows if k == key and s is not None)
        for a, s in zip([None, *times], times, strict=False):
            if a is None or s - a >= gap:
                want.append([str(key), s, s, 0])
            want[-1][2], want[-1][3] = s + gap, want[-1][3] + 1
    got = windows.sessions(events(spark, rows), "user", "ts", "event_id", gap, bucket)
    assert got.columns == ["user", "start", "end", "n"]
    assert sorted([str(r.user), (r.start - START).total_seconds(), (r.end - START).total_seconds(), r.n] for r in got.collect()) == sorted(want)


@pytest.mark.parametrize(("cooldown", "calm"), [(0, 0.6), (7, 0.02), (300, 0.0), (300, 0.02), (2000, 0.0), (10**6, 0.02)])
def test_alerts_of_one_metric(spark, monkeypatch, cooldown, calm):
    """All rows under one metric, whose state may last from the first to the last: short buckets, so that chains cross them."""
    monkeypatch.setattr(metrics, "BUCKET_S", 1000)
    monkeypatch.setattr(metrics, "COOLDOWNS", 3)
    rng = random.Random(cooldown)
    at = sorted(rng.randrange(20_000) for _ in range(600)) + [50_000, 50_000, 90_000]
    samples = [(START + timedelta(seconds=s), i, 10.0 if rng.random() < calm else rng.choice([70.0, 95.0]) if calm else 70.0) for i, s in enumerate(at)]
    t = metrics.Threshold(60, 90, cooldown_s=cooldown)
    df = spark.createDataFrame([("m", *s) for s in samples] + [("quiet", START, 1, 0.0), (None, START, 2, 99.0)], "m string, ts timestamp, i long, v double")
    got = metrics.alerts(df.repartition(3), "m", "v", "ts", "i", t).collect()
    assert sorted((at[r.i], r.previous_state, r.state, r.kind) for r in got if r.m == "m") == sorted(plain_alerts([(s, v) for s, (_, _, v) in zip(at, samples, strict=True)], t))
    assert [(r.m, r.kind) for r in got if r.m != "m"] == [(None, "alert")]


def tasks_with_rows(df):
    """Of the last exchange by bucket: groups, and the most rows in one."""
    counts = df.collect()
    return len(counts), max(r["count"] for r in counts)


def test_a_hot_key_is_many_groups(spark, monkeypatch):
    seen = []
    plain = metrics.with_previous
    monkeypatch.setattr(windows, "with_previous", lambda df, by, *a: seen.append((df, by, a)) or plain(df, by, *a))
    df = spark.range(20_000).select(F.lit("hot").alias("user"), "id", F.timestamp_seconds(F.col("id") * 60).alias("ts")).withColumnRenamed("id", "event_id")
    assert windows.sessions(df, "user", "ts", "event_id", 30, 86_400).count() == 20_000
    rows, _, (_, _, _, bucket) = seen[0]
    groups, most = tasks_with_rows(rows.groupBy(F.floor(F.unix_micros("t") / (bucket * 1_000_000)).alias("b")).count())
    assert groups == 14 and most == 1440
    plan = windows.trailing_counts(df, "user", "ts", 3600, "c")._jdf.queryExecution().executedPlan().toString()
    ordered = [line for line in plan.splitlines() if "Window" in line and "windowspecdefinition(k" in line]
    assert ordered and all("bucket" in line for line in ordered)

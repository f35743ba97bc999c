"""Streaming twins: scanning, windowed counts, thresholds, sessions and sinks on live data."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.detect import find_all
from ..operators.metrics import Threshold


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 16, kind: str = "parquet") -> DataFrame:
    """A folder of files as a stream; the number of files per trigger bounds a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(path)


def scan_stream(docs: DataFrame, names: Iterable[str], key: str = "doc_id", text: str = "text", max_bytes: int | None = None) -> DataFrame:
    """Spans of each document as it comes; stateless."""
    return docs.select(F.col(key), F.inline(find_all(F.col(text), names, max_bytes)))


def windowed_counts(events: DataFrame, ts: str, by: Iterable[str], length: str = "5 minutes", slide: str | None = None, late: str = "10 minutes", value: str | None = None) -> DataFrame:
    """Counts (and sums) by tumbling or sliding window; rows later than `late` are dropped, which bounds the state."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    aggregates = [F.count("*").alias("n")] + ([F.sum(value).alias("total")] if value else [])
    return events.withWatermark(ts, late).groupBy(w, *by).agg(*aggregates).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", *(["total"] if value else []))


def over_limit(events: DataFrame, ts: str, key: str, limit: int, length: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Rate limit: keys with over `limit` events in a window."""
    return windowed_counts(events, ts, [key], length, None, late).where(F.col("n") > limit)


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions: runs of a key's events without a gap."""
    return (
        events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
        .select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    )


def deduplicated(events: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """Each key once, whatever is sent again within `late`."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


THRESHOLD_OUT = "metric string, ts timestamp, value double, previous_state string, state string, kind string"


def thresholds(samples: DataFrame, t: Threshold, idle: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """What a threshold tells of each metric of `samples` (metric, ts, value): alerts and recoveries, by the rules of
    `operators.metrics`, whose `alerts` gives the same rows for a table.

    The state per metric is its last state, value and time, and the time of the last alert. Metrics idle for `idle` of
    event time are forgotten; samples later than `late` may be dropped.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, told, value, seen = state.get if state.exists else ("normal", -1.0, 0.0, -1.0)
        out = []
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        for r in rows.itertuples():
            at = r.ts.timestamp()
            rate = abs(r.value - value) / (at - seen) if seen >= 0 and at > seen else None
            now = t.state_of(r.value, rate)
            kind = t.alert(last, now, None if told < 0 else round(at - told, 6))
            if kind:
                out.append((key[0], r.ts, r.value, last, now, kind))
            told = at if kind == "alert" else told
            last, value, seen = now, r.value, at
        state.update((last, told, value, seen))
        newest = int(rows["ts"].iloc[-1].timestamp() * 1000)
        state.setTimeoutTimestamp(max(newest + idle_ms, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["metric", "ts", "value", "previous_state", "state", "kind"])

    timed = samples.withWatermark("ts", late).groupBy("metric")
    return timed.applyInPandasWithState(run, THRESHOLD_OUT, "last string, told double, value double, seen double", "append", GroupStateTimeout.EventTimeTimeout)


def to_files(df: DataFrame, path: str, checkpoint: str, every: str = "10 seconds", kind: str = "json", by: tuple[str, ...] = ()):
    """A file sink, exactly once through its checkpoint."""
    writer = df.writeStream.format(kind).option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=every).outputMode("append")
    return (writer.partitionBy(*by) if by else writer).start()


def to_many(df: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str, every: str = "10 seconds"):
    """One read, many sinks: each micro-batch is cached and given to every sink with its number."""

    def run(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, number)
        finally:
            batch.unpersist()

    return df.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def to_console(df: DataFrame, every: str = "10 seconds", rows: int = 20):
    """A console sink, for watching."""
    return df.writeStream.format("console").option("numRows", rows).option("truncate", False).trigger(processingTime=every).outputMode("append").start()

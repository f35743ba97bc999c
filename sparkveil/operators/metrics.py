"""Metrics: counters, gauges, histograms with nearest-rank percentiles, thresholds, text exports."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.times import micros

PERCENTILES = (("p50", 0.50), ("p75", 0.75), ("p90", 0.90), ("p95", 0.95), ("p99", 0.99))


def counter(df: DataFrame, by: Sequence[str], value: str, ts: str) -> DataFrame:
    """Sum and rate per second between the first and the last sample."""
    span = (micros(F.max(ts)) - micros(F.min(ts))) / 1e6
    return df.groupBy(*by).agg(F.sum(value).alias("total"), F.count("*").alias("n"), F.when(span > 0, F.sum(value) / span).alias("per_second"))


def gauge(df: DataFrame, by: Sequence[str], value: str, ts: str, tie: str) -> DataFrame:
    """Last, least and greatest value."""
    return df.groupBy(*by).agg(F.max_by(value, F.struct(ts, tie)).alias("last"), F.min(value).alias("low"), F.max(value).alias("high"))


#: Parts that the range of a group's values is cut into for percentiles, and length of a time bucket for lags.
PARTS, BUCKET_S = 1024, 86_400


def histogram(df: DataFrame, by: Sequence[str], value: str, percentiles: Sequence[tuple[str, float]] = PERCENTILES) -> DataFrame:
    """count, sum, mean, min, max and nearest-rank percentiles, the element floor((n - 1) * p) of the
    sorted values.

    No group is ever sorted as a whole. Values are counted; the range of a group's values is cut into `PARTS`,
    whose counts, few for each group, tell in which part a rank lies; only the distinct values of these parts are
    ranked, each part apart.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    whole = counts.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum(F.col("_v") * F.col("_n")).alias("sum"), F.min("_v").alias("min"), F.max("_v").alias("max"))
    place = F.nanvl((F.col("_v") - F.col("min")) / F.nullif(F.col("max") - F.col("min"), F.lit(0.0)) * PARTS, F.lit(0.0))
    part = F.when(F.col("_v") == F.col("max"), PARTS - 1).otherwise(F.least(F.coalesce(F.floor(place), F.lit(0)), F.lit(PARTS - 1))).cast("int")
    keyed = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by]
    on = lambda extra=None: _all([*keyed, *([extra] if extra is not None else [])])
    placed = counts.alias("l").join(whole.alias("r"), on()).select("l.*", part.alias("_part"))
    parts = placed.groupBy(*by, "_part").agg(F.sum("_n").alias("_in"))
    w = W.partitionBy(*by).orderBy("_part")
    ranks = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in percentiles]))
    upto = parts.withColumn("_before", F.sum("_in").over(w) - F.col("_in")).withColumn("_all", F.sum("_in").over(W.partitionBy(*by)))
    rank = F.floor((F.col("_all") - 1) * F.col("q.p"))
    wanted = upto.withColumn("q", ranks).where((rank >= F.col("_before")) & (rank < F.col("_before") + F.col("_in"))).select(*by, "_part", (rank - F.col("_before")).alias("_rank"), F.col("q.name").alias("_name"))
    inside = placed.alias("l").join(wanted.select(*by, "_part").distinct().alias("r"), on(F.col("l._part") == F.col("r._part")), "left_semi")
    running = inside.withColumn("_upto", F.sum("_n").over(W.partitionBy(*by, "_part").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)))
    met = wanted.alias("l").join(running.alias("r"), on((F.col("l._part") == F.col("r._part")) & (F.col("_upto") > F.col("_rank")))).select(*[F.col(f"l.{c}").alias(c) for c in by], "_name", "_v")
    found = met.groupBy(*by).agg(*[F.min(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name, _ in percentiles])
    out = whole.alias("l").join(found.alias("r"), on())
    return out.select(*[F.col(f"l.{c}").alias(c) for c in by], "n", "sum", (F.col("sum") / F.col("n")).alias("mean"), "min", "max", *[name for name, _ in percentiles])


def _all(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def timer(df: DataFrame, by: Sequence[str], started: str, ended: str) -> DataFrame:
    """The histogram of milliseconds between two timestamps; rows that end before they start don't count."""
    took = df.withColumn("_ms", (micros(ended) - micros(started)) / 1000.0).where("_ms >= 0")
    return histogram(took, by, "_ms")


@dataclass(frozen=True)
class Threshold:
    """warning, critical: limits, either may be None; comparison: above, below (both strict), equal (within 1e-9) or
    rate_exceeds (absolute change per second since the sample before); cooldown_s: after which a state that lasts is
    alerted again; emit_recovery: whether the return to normal is told."""

    warning: float | None = None
    critical: float | None = None
    comparison: str = "above"
    cooldown_s: float = 60.0
    emit_recovery: bool = True

    def __post_init__(self) -> None:
        if self.comparison not in ("above", "below", "equal", "rate_exceeds"):
            raise ValueError(f"no comparison {self.comparison!r}")

    def crossed(self, value, limit: float, rate):
        """For columns and for numbers alike; `rate` is null or None without a sample before."""
        if self.comparison == "above":
            return value > limit
        if self.comparison == "below":
            return value < limit
        return (value - limit < 1e-9) & (limit - value < 1e-9) if self.comparison == "equal" else rate > limit

    def state(self, value: Column, rate: Column) -> Column:
        out = F.lit("normal")
        for name, limit in (("warning", self.warning), ("critical", self.critical)):
            if limit is not None:
                out = F.when(self.crossed(value, limit, rate), name).otherwise(out)
        return out

    def state_of(self, value: float, rate: float | None) -> str:
        for name, limit in (("critical", self.critical), ("warning", self.warning)):
            if limit is not None and (self.comparison != "rate_exceeds" or rate is not None) and self.crossed(value, limit, rate):
                return name
        return "normal"

    def alert(self, old: str, new: str, since_s: float | None) -> str | None:
        """What a sample tells: alert, recovery or nothing. A worse state always alerts, as does critical that falls to
        warning; a state that lasts alerts again once the cooldown since the last alert (None: never) is over."""
        if new == "normal":
            return "recovery" if old != "normal" and self.emit_recovery else None
        if new != old or since_s is None or since_s >= self.cooldown_s:
            return "alert"
        return None


def with_previous(df: DataFrame, by: Sequence[str], ts: str, tie: str, columns: Sequence[str], bucket_s: int = BUCKET_S) -> DataFrame:
    """`df` with previous_<column>, the value at the sample before by (ts, tie), null at the first.

    Samples are sorted within time buckets, so that a key with most of the rows spreads over its buckets; the
    first of a bucket takes the last of the bucket before, found among the buckets' last rows.
    """
    cut = df.withColumn("_bucket", F.floor(micros(ts) / (bucket_s * 1_000_000)))
    held = F.struct(*[F.col(c).alias(f"previous_{c}") for c in columns])
    last = cut.groupBy(*by, "_bucket").agg(F.max_by(held, F.struct(ts, tie)).alias("_last"))
    last = last.withColumn("_carried", F.lag("_last").over(W.partitionBy(*by).orderBy("_bucket"))).drop("_last")
    w = W.partitionBy(*by, "_bucket").orderBy(ts, tie)
    inside = cut.withColumn("_own", F.lag(held).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    on = _all([*[F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by], F.col("l._bucket") == F.col("r._bucket")])
    joined = inside.alias("l").join(last.alias("r"), on, "left").select("l.*", F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_own")).alias("_previous"))
    return joined.select(*df.columns, *[F.col(f"_previous.previous_{c}") for c in columns])


def rate_of_change(df: DataFrame, by: Sequence[str], value: str, ts: str, tie: str) -> DataFrame:
    """Change per second against the sample before."""
    both = with_previous(df, by, ts, tie, [value, ts])
    seconds = (micros(ts) - micros(f"previous_{ts}")) / 1e6
    return both.withColumn("rate", F.when(seconds > 0, (F.col(value) - F.col(f"previous_{value}")) / seconds)).drop(f"previous_{value}", f"previous_{ts}")


def _graded(df: DataFrame, by: Sequence[str], value: str, ts: str, tie: str, t: Threshold) -> DataFrame:
    rated = rate_of_change(df, by, value, ts, tie) if t.comparison == "rate_exceeds" else df.withColumn("rate", F.lit(None).cast("double"))
    graded = rated.withColumn("state", F.coalesce(t.state(F.col(value), F.abs("rate")), F.lit("normal"))).drop("rate")
    return with_previous(graded, by, ts, tie, ["state"]).withColumn("previous_state", F.coalesce("previous_state", F.lit("normal")))


def transitions(df: DataFrame, by: Sequence[str], value: str, ts: str, tie: str, t: Threshold) -> DataFrame:
    """Rows at which a metric's state changes: previous_state and state, recoveries among them if wanted."""
    changed = _graded(df, by, value, ts, tie, t).where("state <> previous_state")
    return changed if t.emit_recovery else changed.where("state <> 'normal'")


#: An alert bucket is so many cooldowns long, `BUCKET_S` at least.
COOLDOWNS = 64
ALWAYS = 2**63 - 1


def _ends(at: np.ndarray, fresh: np.ndarray, cooldown: int) -> tuple[np.ndarray, np.ndarray]:
    """For samples outside of normal in order: the next one that alerts if this one does (their number if none), and the last
    one that alerts then. A fresh sample, whose state is new, always alerts. Chains are followed by pointer doubling."""
    n = len(at)
    turns = np.append(np.flatnonzero(fresh), n)
    order = np.arange(n)
    following = np.minimum(np.maximum(np.searchsorted(at, at + cooldown), order + 1), turns[np.searchsorted(turns, order, side="right")])
    last, jump = order.copy(), following
    while (go := jump < n).any():
        last = np.where(go, last[np.where(go, jump, 0)], last)
        jump = np.where(go, jump[np.where(go, jump, 0)], n)
    return following, last


def alerts(df: DataFrame, metric: str, value: str, ts: str, tie: str, t: Threshold) -> DataFrame:
    """What a threshold tells: (metric, ts, tie, value, previous_state, state, kind), kind alert or recovery (see
    `Threshold.alert`).

    States and changes come from `transitions`' bucketed windows. When a lasting state is told again depends on when it was
    told last, so a time bucket of a metric becomes a function: from the time of the last alert before it to that of the last
    alert in it. Only the samples of its first cooldown can be the first to alert, so the function is short: (time from which
    a sample alerts, last alert then). The functions of a metric are applied one after the other; what comes out is where each
    bucket starts, and all buckets then run apart. A task holds one bucket of a metric, a metric's task one function.
    """
    cooldown = round(t.cooldown_s * 1_000_000)
    length = max(round(COOLDOWNS * t.cooldown_s), BUCKET_S) * 1_000_000
    names = list(dict.fromkeys([metric, ts, tie, value]))
    rows = _graded(df, [metric], value, ts, tie, t).where("state <> 'normal' OR previous_state <> 'normal'").select(*names, "previous_state", "state", micros(ts).alias("_us"))
    rows = rows.withColumns({"_metric": F.coalesce(F.concat(F.lit("="), F.col(metric).cast("string")), F.lit("")), "_bucket": F.floor(F.col("_us") / length)})
    narrow = rows.where("state <> 'normal'").select("_metric", "_bucket", "_us", (F.col("state") != F.col("previous_state")).alias("_fresh"), F.col(tie).alias("_tie"))

    def shorten(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_us", "_tie"], na_position="first", kind="stable")
        at, fresh = frame["_us"].to_numpy(), frame["_fresh"].to_numpy()
        _, last = _ends(at, fresh, cooldown)
        start = int(frame["_bucket"].iloc[0]) * length
        first = np.flatnonzero(fresh | (at >= start + cooldown))
        count = int(first[0]) + 1 if len(first) else len(at)
        admit = np.where(fresh[:count], ALWAYS, at[:count])
        admit, kept = np.unique(admit, return_index=True)
        return pd.DataFrame({"_metric": [frame["_metric"].iloc[0]], "_bucket": [frame["_bucket"].iloc[0]], "admit": [admit], "told": [at[last[kept]]]})

    functions = narrow.groupBy("_metric", "_bucket").applyInPandas(shorten, "_metric string, _bucket long, admit array<long>, told array<long>")

    def chain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, told = None, -ALWAYS
        for frame in frames:
            entered = []
            for key, admit, after in zip(frame["_metric"], frame["admit"], frame["told"], strict=True):
                now, told = (now, told) if key == now else (key, -ALWAYS)
                entered.append(told)
                i = int(np.searchsorted(admit, told + cooldown))
                told = int(after[i]) if i < len(admit) else told
            yield pd.DataFrame({"_key": frame["_metric"], "_at": frame["_bucket"], "_told": entered})

    entries = functions.repartition("_metric").sortWithinPartitions("_metric", "_bucket").mapInPandas(chain, "_key string, _at long, _told long")
    schema = rows.drop("_us", "_metric", "_bucket").withColumn("kind", F.lit("")).schema

    def tell(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([ts, tie], na_position="first", kind="stable")
        calm = (frame["state"] == "normal").to_numpy()
        at, fresh = frame["_us"].to_numpy()[~calm], (frame["state"] != frame["previous_state"]).to_numpy()[~calm]
        alert = np.zeros(len(at), bool)
        if len(at):
            following, _ = _ends(at, fresh, cooldown)
            entry = np.flatnonzero(fresh | (at >= int(frame["_told"].iloc[0]) + cooldown))
            i = int(entry[0]) if len(entry) else len(at)
            while i < len(at):
                alert[i] = True
                i = int(following[i])
        kind = np.full(len(frame), None, object)
        kind[np.flatnonzero(~calm)[alert]] = "alert"
        if t.emit_recovery:
            kind[calm] = "recovery"
        return frame.assign(kind=kind).loc[pd.notna(kind), schema.names]

    placed = rows.join(entries, (F.col("_metric") == F.col("_key")) & (F.col("_bucket") == F.col("_at")), "left").fillna({"_told": -ALWAYS})
    return placed.groupBy("_metric", "_bucket").applyInPandas(tell, schema)


def labelled_key(name: Column, labels: Column) -> Column:
    """name{a="1",b="2"} with labels by name."""
    parts = F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"')))
    return F.when(F.size(parts) > 0, F.concat(name, F.lit("{"), F.array_join(parts, ","), F.lit("}"))).otherwise(name)


def prometheus(df: DataFrame, name: str, value: str, labels: Sequence[str] = (), kind: str = "gauge") -> DataFrame:
    """Lines of the text exposition format: (line)."""
    safe = "".join(c if c.isalnum() or c in "_:" else "_" for c in name)
    escape = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r'([\\"])', r"\\$1"), "\n", r"\\n")
    parts = [F.concat(F.lit(f'{c}="'), escape(c), F.lit('"')) for c in labels]
    body = F.concat(F.lit(safe), F.lit("{"), F.concat_ws(",", *parts), F.lit("} ")) if parts else F.lit(f"{safe} ")
    head = df.sparkSession.createDataFrame([(f"# TYPE {safe} {kind}",)], "line string")
    return head.union(df.select(F.concat(body, F.col(value).cast("string")).alias("line")))


def statsd(df: DataFrame, name: str, value: str, kind: str = "g") -> DataFrame:
    """Lines of the StatsD protocol: (line)."""
    return df.select(F.concat(F.lit(f"{name}:"), F.col(value).cast("string"), F.lit(f"|{kind}")).alias("line"))

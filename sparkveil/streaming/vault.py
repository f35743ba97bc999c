"""The token vault as state of a stream: tokens numbered by session and entity type, forgotten when a session is over."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TOKENIZED = "session_id string, ts timestamp, entity_type string, original string, token string"


class SessionVault(StatefulProcessor):
    """For each session a map from (entity type, original) to its number, how many numbers a type has, and a timer. A map
    entry is a row of the state store of its own, so a batch reads and writes only the entries that it names."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.numbers = handle.getMapState("numbers", "entity_type string, original string", "number long")
        self.used = handle.getMapState("used", "entity_type string", "n long")
        self.seen = handle.getValueState("seen", "at long")

    def _flush(self) -> None:
        for state in (self.numbers, self.used, self.seen):
            state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = self.seen.get()[0] if self.seen.exists() else -1
        if newest >= 0 and timerValues.getCurrentWatermarkInMs() > newest + self.ttl_ms:  # over, though its timer is still to come
            self._flush()
            newest = -1
        for frame in rows:
            frame = frame.sort_values(["ts", "entity_type", "original"], kind="stable")
            tokens = []
            for kind, original in zip(frame["entity_type"], frame["original"], strict=True):
                if pd.isna(kind) or pd.isna(original):
                    tokens.append(None)
                    continue
                if self.numbers.containsKey((kind, original)):
                    number = self.numbers.getValue((kind, original))[0]
                else:
                    number = (self.used.getValue((kind,))[0] if self.used.containsKey((kind,)) else 0) + 1
                    self.used.updateValue((kind,), (number,))
                    self.numbers.updateValue((kind, original), (number,))
                tokens.append(f"<{kind.upper()}_{number}>")
            times = frame["ts"].dropna()
            newest = max(newest, int(times.max().timestamp() * 1000)) if len(times) else newest
            yield pd.DataFrame({"session_id": key[0], "ts": frame["ts"], "entity_type": frame["entity_type"], "original": frame["original"], "token": tokens})
        if newest >= 0:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.seen.update((newest,))
            self.handle.registerTimer(newest + self.ttl_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._flush()
        yield from ()


def tokenized(values: DataFrame, ttl_s: float, late: str = "10 minutes") -> DataFrame:
    """`values` (session_id, ts, entity_type, original) with their tokens: `<TYPE_n>`, where n counts the distinct originals of
    a type in a session as they come. Equal originals of a session have equal tokens, over micro-batches and restarts from the
    checkpoint, until no row of the session has come for `ttl_s` of event time; after that numbers begin anew.

    Null types and originals have no token; rows later than `late` may be dropped. One session's entries lie in the state store,
    not in memory. Needs the RocksDB state store (`spark.sql.streaming.stateStore.providerClass`).
    """
    rows = values.select("session_id", "ts", "entity_type", "original").withWatermark("ts", late)
    return rows.groupBy("session_id").transformWithStateInPandas(SessionVault(round(ttl_s * 1000)), TOKENIZED, "append", "EventTime")

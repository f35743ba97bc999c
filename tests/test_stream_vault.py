"""Tokens of a stream: stable within a session, over micro-batches and a restart, and gone when the session is over."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from sparkveil.streaming import vault

START = datetime(2024, 1, 1)
SCHEMA = "session_id string, ts timestamp, entity_type string, original string"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_tokens_live_as_long_as_their_session(rocks, tmp_path):
    spark, folder, out, checkpoint = rocks, *(str(tmp_path / x) for x in ("in", "out", "c"))

    def run(*rows):
        """One start of the query on new rows (session, seconds, type, original): their tokens."""
        spark.createDataFrame([(s, START + timedelta(seconds=at), k, v) for s, at, k, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        live = vault.tokenized(spark.readStream.schema(SCHEMA).parquet(folder), 600, "1 seconds")
        q = live.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        assert q.awaitTermination(180)
        seen = {(r.session_id, r.ts, r.entity_type, r.original): r.token for r in spark.read.parquet(out).collect()}
        return [seen[s, START + timedelta(seconds=at), k, v] for s, at, k, v in rows]

    first = run(("a", 0, "name", "Ann"), ("a", 1, "name", "Bob"), ("a", 2, "name", "Ann"), ("a", 3, "email", "Ann"), ("b", 4, "name", "Bob"), ("b", 5, "name", None))
    assert first == ["<NAME_1>", "<NAME_2>", "<NAME_1>", "<EMAIL_1>", "<NAME_1>", None]
    assert run(("a", 300, "name", "Bob"), ("a", 301, "name", "Cy"), ("c", 302, "name", "Bob")) == ["<NAME_2>", "<NAME_3>", "<NAME_1>"]  # from the checkpoint
    assert run(("a", 800, "name", "Cy"), ("b", 801, "name", "Dan")) == ["<NAME_3>", "<NAME_2>"]  # b was idle, but no watermark has passed its end
    run(("z", 5000, "name", "Zoe"))
    assert run(("a", 5001, "name", "Cy"), ("a", 5002, "name", "Bob"), ("z", 5003, "name", "Zoe")) == ["<NAME_1>", "<NAME_2>", "<NAME_1>"]

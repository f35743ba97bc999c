"""Token vault: stable tokens for original values, by session and entity type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import micros

KEY = ("session_id", "entity_type", "original")


def token(session: Column, entity: Column, original: Column, secret: str) -> Column:
    """A keyed hash, so that every executor and every run gives a value the same token."""
    return F.concat(F.upper(entity), F.lit("_"), F.substring(F.sha2(F.concat_ws("\x1f", F.lit(secret), session, entity, original), 256), 1, 16))


def entries(values: DataFrame, secret: str) -> DataFrame:
    """The vault rows (session_id, entity_type, original, token) of all distinct non-null values."""
    rows = values.select(*KEY).where(F.col("original").isNotNull()).distinct()
    return rows.withColumn("token", token(F.col("session_id"), F.col("entity_type"), F.col("original"), secret))


def get_or_put(vault: DataFrame, values: DataFrame, secret: str) -> tuple[DataFrame, DataFrame]:
    """(values with their tokens, vault rows to append). Known values keep the token they have."""
    fresh = entries(values, secret).join(vault, list(KEY), "left_anti")
    return values.join(vault.unionByName(fresh), list(KEY), "left"), fresh


def reveal(vault: DataFrame, tokens: DataFrame) -> DataFrame:
    """`tokens` (session_id, token, ...) with the original, null where the session doesn't know it."""
    return tokens.join(vault.select("session_id", "token", "original"), ["session_id", "token"], "left")


def expire(vault: DataFrame, sessions: DataFrame, ttl_s: int, now: Column) -> DataFrame:
    """The vault without sessions whose `last_seen` is over `ttl_s` seconds ago."""
    live = sessions.where(micros(now) - micros("last_seen") <= ttl_s * 1_000_000).select("session_id")
    return vault.join(live, "session_id", "left_semi")

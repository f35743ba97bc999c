"""Session settings that the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "sparkveil", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; `settings` are further Spark settings."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

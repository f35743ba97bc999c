"""Time as numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone (taken as the session's)."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))

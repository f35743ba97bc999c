"""Audit queries: optional predicates, ordering, paging and counts over an event table."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import SEVERITY
from .windows import trailing_counts

# The severity that an event type has by default.
EVENT_SEVERITY = {
    "view": "debug", "click": "info", "signup": "info", "purchase": "warning", "error": "error", "login_success": "info", "login_failure": "warning",
    "authentication_error": "error", "authorization_error": "error", "validation_error": "warning", "system_error": "critical",
}


def severity_rank(severity: Column) -> Column:
    out = F.lit(None).cast("int")
    for rank, name in enumerate(SEVERITY):
        out = F.when(severity == name, rank).otherwise(out)
    return out


def default_severity(event_type: Column) -> Column:
    out = F.lit("info")
    for name, severity in EVENT_SEVERITY.items():
        out = F.when(event_type == name, severity).otherwise(out)
    return out


@dataclass(frozen=True)
class AuditQuery:
    """Every field is optional. `since` is inclusive, `until` exclusive; an empty `event_types` matches
    nothing. Rows whose value is null never match an equality."""

    since: datetime | None = None
    until: datetime | None = None
    event_types: tuple[str, ...] | None = None
    min_severity: str | None = None
    tenant_id: str | None = None
    user_id: object = None
    correlation_id: str | None = None
    resource_type: str | None = None
    resource_id: str | None = None
    security_only: bool = False
    pii_only: bool = False
    phi_only: bool = False
    limit: int | None = None
    offset: int | None = None
    ascending: bool = False

    @classmethod
    def last_days(cls, days: int, now: datetime) -> AuditQuery:
        return cls(since=now - timedelta(days=days))

    @classmethod
    def security_events(cls, days: int, now: datetime) -> AuditQuery:
        return cls(since=now - timedelta(days=days), security_only=True)

    @classmethod
    def failed_logins(cls, since: datetime) -> AuditQuery:
        return cls(since=since, event_types=("login_failure", "authentication_error"))

    @classmethod
    def by_correlation(cls, correlation_id: str) -> AuditQuery:
        return cls(correlation_id=correlation_id, ascending=True)

    @classmethod
    def by_user(cls, user_id: object) -> AuditQuery:
        return cls(user_id=user_id, ascending=True)

    def page(self, offset: int, limit: int) -> AuditQuery:
        return replace(self, offset=offset, limit=limit)

    def predicate(self, ts: str = "timestamp") -> Column:
        """All set conditions; what the source can take is pushed down to it."""
        out = F.lit(True)
        if self.since is not None:
            out = out & (F.col(ts) >= F.lit(self.since))
        if self.until is not None:
            out = out & (F.col(ts) < F.lit(self.until))
        if self.event_types is not None:
            out = out & (F.col("event_type").isin(*self.event_types) if self.event_types else F.lit(False))
        if self.min_severity is not None:
            out = out & (severity_rank(F.col("severity")) >= SEVERITY.index(self.min_severity))
        for name in ("tenant_id", "user_id", "correlation_id", "resource_type", "resource_id"):
            if (value := getattr(self, name)) is not None:
                out = out & (F.col(name) == F.lit(value))
        for flag, name in ((self.security_only, "security_relevant"), (self.pii_only, "contains_pii"), (self.phi_only, "contains_phi")):
            if flag:
                out = out & F.col(name)
        return out

    def filtered(self, events: DataFrame, ts: str = "timestamp") -> DataFrame:
        return events.where(self.predicate(ts))

    def run(self, events: DataFrame, ts: str = "timestamp", tie: str = "id") -> DataFrame:
        """Filter, sort by time (and `tie`), skip, take."""
        order = [F.col(ts).asc(), F.col(tie).asc()] if self.ascending else [F.col(ts).desc(), F.col(tie).desc()]
        out = self.filtered(events, ts).orderBy(*order)
        if self.offset:
            out = out.offset(self.offset)
        return out if self.limit is None else out.limit(self.limit)

    def count(self, events: DataFrame, ts: str = "timestamp") -> int:
        return self.filtered(events, ts).count()

    def has_more(self, events: DataFrame, ts: str = "timestamp") -> bool:
        """Whether rows follow the page."""
        return self.limit is not None and self.count(events, ts) > (self.offset or 0) + self.limit


def recent(events: DataFrame, n: int, ts: str = "timestamp", tie: str = "id") -> DataFrame:
    return AuditQuery(limit=n).run(events, ts, tie)


def failures_in_window(events: DataFrame, failed: Column, seconds: int, limit: int, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Failed events with `n_failures`, those of the user in the last `seconds`, and `locked` from `limit` on."""
    counted = trailing_counts(events.where(failed), user, ts, seconds, "n_failures")
    return counted.withColumn("locked", F.col("n_failures") >= limit)

"""Redaction of single values and of texts by policy: skip, partial, complete or anonymous."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import masking
from .detect import gate, guard
from .patterns import BY_NAME
from .redact import rewritten

POLICIES = ("skip", "partial", "complete", "anonymous")

#: The partial form of a type, where it has one of its own.
PARTIAL: dict[str, Callable[[Column], Column]] = {
    "email": lambda v: masking.email(v, "show_first"),
    "credit_card": masking.digits_last_four,
    "ssn": masking.digits_last_four,
    "phone": masking.digits_last_four,
    "bank_account": masking.digits_last_four,
    "routing_number": masking.digits_last_four,
    "iban": lambda v: masking.show_both(v, 4, 4),
    "ip_address": masking.ip_first_octet,
    "mac_address": lambda v: masking.show_first(v, 8),
    "uuid": lambda v: masking.show_first(v, 8),
    "name": lambda v: F.regexp_replace(v, r"([\p{L}])[\p{L}']*", "$1."),
    "birthdate": masking.birth_year,
    "age": lambda v: masking.age_bucket(F.regexp_extract(v, "([0-9]{1,3})", 1).try_cast("int")),
    "gps_coordinates": lambda v: F.regexp_replace(v, r"(\.[0-9])[0-9]+", "$1"),
    "postal_code": lambda v: masking.show_first(v, 3),
    "url": lambda v: F.regexp_extract(v, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?#]+", 0),
    "vin": lambda v: masking.show_last(v, 6),
}


def redact_value(value: Column, kind: str, policy: str = "complete") -> Column:
    """One value as the policy shows it; null stays null."""
    if policy not in POLICIES:
        raise ValueError(f"no policy {policy!r}; there are {POLICIES}")
    if policy == "skip":
        return value
    if policy == "partial":
        return PARTIAL.get(kind, masking.partial)(value)
    return F.when(value.isNotNull(), BY_NAME[kind].label if policy == "complete" else "[REDACTED]")


def redact_texts(df: DataFrame, column: str, names: Iterable[str], policy: str = "complete", max_bytes: int | None = None) -> DataFrame:
    """`df` with the identifiers of `names` in `column` rewritten by one policy, a projection per type."""
    if policy not in POLICIES:
        raise ValueError(f"no policy {policy!r}; there are {POLICIES}")
    if policy == "skip":
        return df
    for name in names:
        t = F.col(column)
        done = rewritten(t, BY_NAME[name], _rewrite(name, policy))
        df = df.withColumn(column, F.when(guard(t, max_bytes) & gate(t, BY_NAME[name]), done).otherwise(t))
    return df


def _rewrite(name: str, policy: str) -> Callable[[Column], Column]:
    return lambda match: redact_value(match, name, policy)

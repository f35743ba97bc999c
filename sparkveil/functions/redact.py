"""Redaction of texts by profile: one projection of nested replacements, no shuffle, no Python.

Types are rewritten in scanner order, each over what the one before has left, and a type's patterns one after
the other. Types without a validator are plain regular-expression replacements; the others rewrite the matches that pass
between the gaps. Both take time in proportion to the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import masking
from .arrays import bind
from .detect import gate, guard, passes, replaced, scan, types_of
from .patterns import BY_NAME, Type

PROFILES = ("production_strict", "production_lenient", "development", "testing")


def _java(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


def partial_of(kind: Type) -> Callable[[Column], Column] | None:
    """How a lenient profile writes a match; None: as the strict one."""
    if kind.name == "email":
        return lambda v: masking.email(v, "show_first")
    if kind.name in ("credit_card", "ssn", "phone"):
        return lambda v: masking.digits_last_four(v)
    if kind.domain in ("location", "biometric"):
        return masking.partial
    return None


def redact_type(text: Column, name: str, profile: str = "production_strict", max_bytes: int | None = None) -> Column:
    """`text` with the matches of one type rewritten as the profile has it."""
    kind = BY_NAME[name]
    if profile not in PROFILES:
        raise ValueError(f"no profile {profile!r}; there are {PROFILES}")
    if profile == "testing" or not kind.redacted:
        return text
    develop = profile == "development"
    if develop and name not in ("ssn", "credit_card") and kind.domain != "tokens":
        return text
    lenient = partial_of(kind) if profile == "production_lenient" or develop else None
    if name == "ip_address":
        kept = F.regexp_replace(text, r"\b([0-9]{1,3})\.(?:[0-9]{1,3}\.){2}[0-9]{1,3}\b", "$1.***.***.***")
        return F.when(guard(text, max_bytes), F.regexp_replace(kept, kind.patterns[1], _java(kind.label))).otherwise(text)
    if name == "password":
        return F.when(guard(text, max_bytes), F.regexp_replace(text, r"(?i)\b(password|passwd|pwd)(\s*[=:]\s*)[^\s,;]+", "$1$2\\[PASSWORD\\]")).otherwise(text)
    if kind.check is None and lenient is None:
        out = text
        for pattern in kind.patterns:
            out = F.regexp_replace(out, pattern, _java(kind.label))
        return F.when(guard(text, max_bytes), out).otherwise(text)
    rewrite = lenient or (lambda m: F.lit(kind.label))
    if name == "ssn" and lenient is None:  # the label in front stays
        rewrite = lambda m: F.concat(F.regexp_extract(m, "^[^0-9]*", 0), F.lit(kind.label))
    return F.when(guard(text, max_bytes) & gate(text, kind), rewritten(text, kind, rewrite)).otherwise(text)


def rewritten(text: Column, kind: Type, rewrite: Callable[[Column], Column]) -> Column:
    """`text` with the matches of a type that pass its validator rewritten, pattern by pattern."""

    def good(m: Column) -> Column:
        return F.when(passes(kind, m), rewrite(m)).otherwise(m)

    def step(pattern: str) -> Callable[[Column], Column]:
        return lambda t: replaced(t, pattern, good)

    out = text
    for pattern in kind.patterns:
        out = bind(out, step(pattern))
    return out


def redact(text: Column, profile: str = "production_strict", preset: str | Iterable[str] = "default", max_bytes: int | None = None) -> Column:
    """`text` with every type of the preset's domains redacted: it is scanned once, and each type found is rewritten
    over what the one before has left."""

    def step(t: Column, name: Column) -> Column:
        out = None
        for kind in types_of(preset):
            if kind.redacted:
                done = redact_type(t, kind.name, profile)
                out = F.when(name == kind.name, done) if out is None else out.when(name == kind.name, done)
        return t if out is None else out.otherwise(t)

    if profile not in PROFILES:
        raise ValueError(f"no profile {profile!r}; there are {PROFILES}")
    if profile == "testing":
        return text
    return F.when(guard(text, max_bytes), F.aggregate(scan(text, preset), text, step)).otherwise(text)


def redact_frame(df, column: str, names: Iterable[str], profile: str = "production_strict", max_bytes: int | None = None, into: str | None = None):
    """`df` with `into` (default: `column` itself) redacted for the types `names`, a projection each, so
    that no replacement repeats the text of the one before."""
    into = into or column
    df = df if into == column else df.withColumn(into, F.col(column))
    for name in names:
        df = df.withColumn(into, redact_type(F.col(into), name, profile, max_bytes))
    return df

"""Masking of single values, in code points. Null stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _n(value: Column | int) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _rep(unit: str, n: Column) -> Column:
    return F.repeat(F.lit(unit), n.cast("int"))


def show_first(value: Column, n: int, unit: str = "*") -> Column:
    """The first n characters, the rest masked; values of at most n characters come back whole."""
    return F.when(F.length(value) <= n, value).otherwise(F.concat(F.substring(value, 1, n), _rep(unit, F.length(value) - n)))


def show_last(value: Column, n: int, unit: str = "*") -> Column:
    return F.when(F.length(value) <= n, value).otherwise(F.concat(_rep(unit, F.length(value) - n), F.right(value, F.lit(n))))


def show_both(value: Column, first: int, last: int, unit: str = "*") -> Column:
    n = F.length(value)
    return F.when(n <= first + last, value).otherwise(F.concat(F.substring(value, 1, first), _rep(unit, n - first - last), F.right(value, F.lit(last))))


def mask_all(value: Column, unit: str = "*") -> Column:
    return _rep(unit, F.length(value))


def mask_middle(value: Column, keep: int = 2, unit: str = "*") -> Column:
    return show_both(value, keep, keep, unit)


def keep_format(value: Column, unit: str = "*") -> Column:
    """Letters and digits masked, everything else kept."""
    return F.regexp_replace(value, r"[\p{L}\p{N}]", unit.replace("\\", "\\\\").replace("$", "\\$"))


def mask_chars(value: Column, n: Column | int, unit: str = "*", from_end: bool = False) -> Column:
    """The first or last n characters, each replaced by `unit`; n is clamped to the length."""
    k = F.greatest(F.lit(0), F.least(_n(n), F.length(value)))
    rest = F.length(value) - k
    if from_end:
        return F.concat(F.substring(value, F.lit(1), rest), _rep(unit, k))
    return F.concat(_rep(unit, k), F.right(value, rest))


def email(value: Column, style: str = "token") -> Column:
    """Styles: token, show_first (u***@host), show_domain (***@host), hash, skip."""
    user, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    return {
        "token": F.lit("[EMAIL]"),
        "show_first": F.concat(F.substring(user, 1, 1), F.lit("***@"), host),
        "show_domain": F.concat(F.lit("***@"), host),
        "hash": F.concat(F.lit("email_"), F.substring(F.sha2(value, 256), 1, 12)),
        "skip": value,
    }[style]


def digits_last_four(value: Column, unit: str = "*") -> Column:
    """All digits but the last four masked; separators kept."""
    last = F.right(F.regexp_replace(value, "[^0-9]", ""), F.lit(4))
    body = F.regexp_replace(F.regexp_replace(value, r"(?:[0-9][^0-9]*){4}$", ""), "[0-9]", unit)
    tail = F.substring(value, F.length(F.regexp_replace(value, r"(?:[0-9][^0-9]*){4}$", "")) + 1, F.length(value))
    return F.when(F.length(last) < 4, mask_all(value, unit)).otherwise(F.concat(body, tail))


def ip_first_octet(value: Column) -> Column:
    return F.regexp_replace(value, r"^([0-9]{1,3})\..*$", "$1.***.***.***")


def age_bucket(age: Column) -> Column:
    """Decades, and 90+ from ninety on; null for ages that no one has."""
    low = (F.floor(age / 10) * 10).cast("int")
    return F.when((age < 0) | (age > 150), F.lit(None).cast("string")).when(age >= 90, "90+").otherwise(F.concat_ws("-", low.cast("string"), (low + 9).cast("string")))


def birth_year(value: Column) -> Column:
    """Only the year of a date, as the anonymous form."""
    return F.regexp_extract(value, r"((?:19|20)[0-9]{2})", 1)


def partial(value: Column) -> Column:
    """The generic partial form: a value of over eight characters shows four at either end, a shorter one its first."""
    return F.when(F.length(value) > 8, show_both(value, 4, 4)).otherwise(show_first(value, 1))


def anonymous(kind: str) -> Column:
    return F.lit(f"<{kind}>")

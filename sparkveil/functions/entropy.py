"""Shannon entropy and character diversity of single values, and high-entropy words of texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DELIMITERS = r"[\s\"'`,;:=(){}\[\]<>|&]+"
HEX_BITS, OTHER_BITS, MIN_LENGTH, DIGIT_PENALTY = 3.0, 4.5, 20, 1.2


def _chars(value: Column) -> Column:
    return F.split(value, "")


def shannon(value: Column) -> Column:
    """Bits per character; 0 for an empty value."""
    chars = _chars(value)
    n = F.length(value)
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    bits = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    return F.when(n > 0, bits + 0.0).when(value.isNotNull(), F.lit(0.0))


def diversity(value: Column) -> Column:
    """struct(unique, classes): distinct characters, and 1 lower + 2 upper + 4 digit + 8 other."""
    has = lambda pattern, bit: F.when(value.rlike(pattern), bit).otherwise(0)
    unique = F.when(F.length(value) > 0, F.size(F.array_distinct(_chars(value)))).otherwise(0)
    return F.struct(unique.alias("unique"), (has("[a-z]", 1) + has("[A-Z]", 2) + has("[0-9]", 4) + has("[^a-zA-Z0-9]", 8)).alias("classes"))


def is_hex(value: Column) -> Column:
    return value.rlike("^[0-9a-fA-F]+$")


def excluded(value: Column) -> Column:
    """Shapes that look random but are no secrets: UUIDs, versions, colours, repeats."""
    return (
        value.rlike(r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$") | value.rlike(r"^v?[0-9]+(?:\.[0-9]+)+")
        | value.rlike(r"^#[0-9a-fA-F]{3,8}$") | value.rlike(r"^(.)\1+$")
    )


def adjusted(value: Column) -> Column:
    """Entropy less the penalty of values that are digits only."""
    return shannon(value) - F.when(value.rlike("^[0-9]+$"), F.lit(DIGIT_PENALTY) / F.log2(F.length(value))).otherwise(0.0)


def is_high_entropy(value: Column) -> Column:
    limit = F.when(is_hex(value), HEX_BITS).otherwise(OTHER_BITS)
    return (F.length(value) >= MIN_LENGTH) & ~excluded(value) & (adjusted(value) >= limit)


def high_entropy_words(text: Column, max_bytes: int | None = None) -> Column:
    """The words of a text, split at white space, quotes and brackets, that have high entropy."""
    long = F.filter(F.split(text, DELIMITERS), lambda w: F.length(w) >= MIN_LENGTH)
    found = F.filter(long, is_high_entropy)
    return found if max_bytes is None else F.when(F.octet_length(text) <= max_bytes, found).otherwise(F.array().cast("array<string>"))

"""Correlation: pairs of identifiers that stand close together in a document, and the credential pairs among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import PROVIDERS

MAX_CHARS, MAX_LINES = 500, 5
#: Types that are keys of some provider or of none.
KEYS = ("api_key", *sorted(PROVIDERS - {"aws_access_key"}))
# The pair types, and what texts of their members hold.
PAIR_TYPES = ("aws_key_pair", "twilio_pair", "token_pair", "key_pair", "oauth_client_pair", "username_password_pair", "azure_service_principal")
OAUTH_WORDS = "oauth|client|authorize|token|auth0|okta"
PUBLIC, PRIVATE = "^pk_|^pub_|public", "^sk_|^sec_|private|secret"


def _in_order(a: Column, x: Column, b: Column, y: Column) -> Column:
    """The pair type of types a, b with texts x, y, in this order; null if none."""
    x, y = F.trim(x), F.trim(y)
    low, high = F.lower(x), F.lower(y)
    keys = a.isin(*KEYS) & b.isin(*KEYS)
    return (
        F.when((a == "aws_access_key") & b.isin(*KEYS) & y.rlike("^[A-Za-z0-9+/=]{40}$"), "aws_key_pair")
        .when(keys & x.rlike("^AC[0-9a-fA-F]{32}$") & y.rlike("^[0-9a-fA-F]{32}$"), "twilio_pair")
        .when((a == "jwt") & b.isin("jwt", *KEYS) | a.isin(*KEYS) & (b == "jwt"), "token_pair")
        .when(keys & (low.rlike(PUBLIC) & high.rlike(PRIVATE) | low.rlike(PRIVATE) & high.rlike(PUBLIC)), "key_pair")
        .when(a.isin("url", "domain") & b.isin("password", *KEYS) & low.rlike(OAUTH_WORDS), "oauth_client_pair")
        .when(a.isin("username", "email") & (b == "password"), "username_password_pair")
        .when((a == "uuid") & b.isin("password", *KEYS), "azure_service_principal")
    )


def pair_type(first: Column, first_text: Column, second: Column, second_text: Column) -> Column:
    """The credential pair that two identifiers make, whichever comes first; null if none."""
    return F.coalesce(_in_order(first, first_text, second, second_text), _in_order(second, second_text, first, first_text))


def proximate_pairs(spans: DataFrame, key: str = "doc_id", max_chars: int = MAX_CHARS, max_lines: int | None = MAX_LINES) -> DataFrame:
    """Pairs of spans of one document with at most `max_chars` characters and `max_lines` line breaks between
    them, with their gap and pair_type, in no order.

    A range join: spans are put into buckets of `max_chars`, and a span meets those that start in its
    bucket or the two after, so that a document full of spans is not joined with itself. `spans` has
    (key, start, end, identifier_type, matched_text) and, unless `max_lines` is None, start_line and end_line
    (see `spans_table`).
    """
    width = max_chars + 1
    names = ["start", "end", "identifier_type", "matched_text", *(["start_line", "end_line"] if max_lines is not None else [])]
    base = spans.select(F.col(key), *names)
    left = base.select(F.col(key), *[F.col(c).alias(f"primary_{c}") for c in names])
    reach = F.sequence(F.floor(F.col("primary_start") / width), F.floor((F.col("primary_end") + max_chars) / width))
    left = left.withColumn("bucket", F.explode(reach))
    right = base.select(F.col(key), *[F.col(c).alias(f"secondary_{c}") for c in names], F.floor(F.col("start") / width).alias("bucket"))
    gap = F.greatest(F.lit(0), F.col("secondary_start") - F.col("primary_end"))
    first = (F.struct("primary_start", "primary_end", "primary_identifier_type") < F.struct(F.col("secondary_start"), F.col("secondary_end"), F.col("secondary_identifier_type")))
    near = first & (gap <= max_chars)
    if max_lines is not None:
        near = near & (F.abs(F.col("secondary_start_line") - F.col("primary_end_line")) <= max_lines)
    joined = left.join(right, [key, "bucket"]).where(near)
    made = pair_type(F.col("primary_identifier_type"), F.col("primary_matched_text"), F.col("secondary_identifier_type"), F.col("secondary_matched_text"))
    return joined.drop("bucket").withColumn("gap", gap).withColumn("pair_type", made)


def credential_pairs(pairs: DataFrame, key: str = "doc_id", enabled: tuple[str, ...] = PAIR_TYPES) -> DataFrame:
    """Pairs that make an enabled pair type, all of high confidence, nearest first within a document."""
    return pairs.where(F.col("pair_type").isin(*enabled)).withColumn("confidence", F.lit("high")).orderBy(key, "gap", "primary_start", "secondary_start")

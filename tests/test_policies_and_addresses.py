from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkveil.functions import address, policies


def test_values(one):
    v = F.col("v")
    for kind, policy, value, expected in [
        ("email", "partial", "user@example.com", "u***@example.com"), ("email", "complete", "user@example.com", "[EMAIL]"), ("email", "anonymous", "x@y.org", "[REDACTED]"), ("email", "skip", "x@y.org", "x@y.org"),
        ("ip_address", "partial", "10.1.2.3", "10.***.***.***"), ("name", "partial", "Ann Lee", "A. L."), ("birthdate", "partial", "1980-02-03", "1980"), ("age", "partial", "42 years", "40-49"),
        ("gps_coordinates", "partial", "52.52001, 13.40495", "52.5, 13.4"), ("mrn", "partial", "MRN 123456789", "MRN *****6789"), ("email", "complete", None, None),
    ]:
        assert one(policies.redact_value(v, kind, policy), v=value) == expected, (kind, policy)
    with pytest.raises(ValueError):
        policies.redact_value(v, "email", "nope")


def test_texts(spark):
    df = spark.createDataFrame([("mail a@b.co from 10.1.2.3",), (None,)], "t string")
    run = lambda p: [r.t for r in policies.redact_texts(df, "t", ["email", "ip_address"], p).collect()]
    assert run("partial") == ["mail a***@b.co from 10.***.***.***", None]
    assert run("complete") == ["mail [EMAIL] from [IP_ADDRESS]", None]
    assert run("skip") == ["mail a@b.co from 10.1.2.3", None]


def test_addresses(one):
    v = F.col("v")
    assert one(address.normalize_address(v), v="12  north MAIN street  Apartment 4") == "12 N Main St Apt 4"
    assert one(address.normalize_postal(v, "UK"), v="sw1a1aa") == "SW1A 1AA"
    assert one(address.normalize_postal(v, "US"), v="12345 6789") == "12345-6789"
    assert one(address.normalize_postal(v, "CA"), v="12345") is None
    assert one(address.postal_country(v), v="12345-678") == ["BR"]

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from sparkveil.functions import dates, detect


@pytest.mark.parametrize(("value", "born"), [
    ("1990-05-15", (1990, 5, 15)), (" 05/15/1990 ", (1990, 5, 15)), ("15/05/1990", (1990, 5, 15)), ("03/04/1990", (1990, 3, 4)), ("2000-02-29", (2000, 2, 29)), ("1900-02-29", None), ("02/30/2000", None),
    ("13/13/2000", None), ("5/6/0999", None), ("1990/05/15", None), ("1850-01-01", (1850, 1, 1)), ("", None), (None, None), ("soon", None),
])
def test_birthdate(one, value, born):
    v = F.lit(value).cast("string")
    assert one(dates.birthdate(v)) == (datetime.date(*born) if born else None)
    assert one(dates.is_birthdate(v)) is bool(born)


def test_ages(one):
    day = lambda s: F.lit(s).cast("date")
    assert one(dates.is_birthdate(F.lit("2031-01-01"), day("2030-12-31"))) is False
    assert [one(dates.age_at(day(b), day("2024-06-30"))) for b in ("1990-06-30", "1990-07-01", "1850-01-01", "2025-01-01")] == [34, 33, None, None]
    assert [one(dates.is_age(F.lit(v).cast("string"))) for v in ("42", " 150 ", "151", "-1", "x", "", None)] == [True, True, False, False, False, False, False]


def test_medical_order(one):
    got = [one(detect.medical_type(F.lit(v).cast("string"))) for v in ("NPI 1245319599", "AB1234563", "MRN 12345678", "E11.9", "hello", None)]
    assert got == ["npi", "dea_number", "mrn", "icd_code", None, None]

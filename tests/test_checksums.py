from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkveil.functions import checksums, context

GOOD = {
    "luhn": "4532015112830366", "card": "378282246310005", "aba": "021000021", "iban": "GB82 WEST 1234 5698 7654 32", "ssn": "517-29-8346", "npi": "1245319599", "dea": "AB1234563",
    "vin": "1HGCM82633A004352", "aadhaar": "234123412346", "gstin": "27AAPFU0939F1ZV", "tfn": "123 456 782", "abn": "51 824 753 556", "medicare": "2123 45670 1", "acn": "004 085 616",
    "cpf": "111.444.777-35", "cnpj": "11.222.333/0001-81", "pesel": "44051401359", "hetu": "131052-308T", "tckn": "10000000146", "nif": "12345678Z", "nie": "X1234567L",
    "fiscal_code": "RSSMRA85M01H501Q", "vat_italy": "12345678903", "nric": "S1234567D", "nhs": "943 476 5919", "personnummer": "811228-9874", "sin_canada": "130 692 544",
    "brn": "220-81-62517", "curp": "HEGG560427MVZRRL04", "tnin": "1-1017-00230-70-8", "rrn": "900101-1234568", "itin": "912-70-1234", "pan_india": "ABCPE1234F",
}
BAD = {
    "ssn": ["000-12-3456", "666-12-3456", "900-12-3456", "517-00-8346", "517-29-0000", "123-45-6789", "078-05-1120"], "npi": ["1234567890"], "card": ["4242424242424241", "1111111111111111", "42"],
    "iban": ["GB82 WEST 1234 5698 7654 33", "DE82WEST12345698765432", "XX00AAAA12345678901"], "aba": ["021000022", "990000005"], "vin": ["1HGCM82633A004353", "IHGCM82633A004352"],
    "cpf": ["111.111.111-11", "111.444.777-36"], "aadhaar": ["234123412347", "134123412346"], "dea": ["AB1234564"], "nie": ["X1234567M"], "luhn": ["4532015112830367", "", "x"],
}


def test_known_good(spark):
    df = spark.createDataFrame(list(GOOD.items()), "kind string, value string")
    checked = F.coalesce(*[F.when(F.col("kind") == k, checksums.VALIDATORS[k](F.col("value"))) for k in GOOD])
    assert [r.kind for r in df.withColumn("ok", checked).where("not ok or ok is null").collect()] == []


def test_known_bad(spark):
    rows = [(k, v) for k, values in BAD.items() for v in values]
    df = spark.createDataFrame(rows, "kind string, value string")
    checked = F.coalesce(*[F.when(F.col("kind") == k, checksums.VALIDATORS[k](F.col("value"))) for k in BAD])
    assert [(r.kind, r.value) for r in df.withColumn("ok", checked).where("ok").collect()] == []


@pytest.mark.parametrize("name", sorted(checksums.VALIDATORS))
def test_null_and_noise(spark, name):
    df = spark.createDataFrame([(None,), ("",), ("é" * 40,), ("-",)], "v string")
    assert [r[0] for r in df.select(checksums.VALIDATORS[name](F.col("v"))).collect()] == [None, False, False, False]


def test_brand_and_license(one):
    assert one(checksums.card_brand(F.col("v")), v="4242424242424242") == "visa"
    assert one(checksums.card_brand(F.col("v")), v="378282246310005") == "amex"
    assert one(checksums.card_brand(F.col("v")), v="4242") is None
    for number, brand in [("2221000000000009", "mastercard"), ("6445000000000000", "discover"), ("5060990000000000", "verve"), ("6200000000000005", "unionpay"), ("5893000000000000", "maestro"), ("6080000000000000", "rupay"), ("9999990000000000", None)]:
        assert one(checksums.card_brand(F.col("v")), v=number) == brand
    assert one(checksums.driver_license(F.col("v"), F.col("s")), v="A1234567", s="CA") is True
    assert one(checksums.driver_license(F.col("v"), F.col("s")), v="A1234567", s="ZZ") is None


def test_card_score(one):
    """The sum of the steps: shape, Luhn, brand, its length, test card, context, runs of digits."""
    score = lambda v, c=None: one(context.card_score(F.col("v"), F.col("c").cast("string")), v=v, c=c or "")
    assert score("4539 1488 0343 6467") == 0.9 and score("4539148803436467", "my visa") == 1.1
    assert score("4242424242424242") == 0.6 and score("4539148803436468") == 0.1
    assert score("1234567890123452") == 0.3 and score("1234") is None
    assert one(context.confidence(F.lit(0.9)), v="") == "high" and one(context.confidence(F.lit(0.1)), v="") is None

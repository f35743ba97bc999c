"""HMAC and HKDF against the test vectors of RFC 4231 and RFC 5869, and against Python."""

from __future__ import annotations

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from sparkveil.functions import keyed, tokens
from sparkveil.operators import anonymize as anon

# Fixed values of RFC 4231: key, data, HMAC-SHA-256.
RFC4231 = (
    ("0b" * 20, "4869205468657265", "b0344c61d8db38535ca8afceaf0bf12b881dc200c9833da726e9376c2e32cff7"),
    ("4a656665", "7768617420646f2079612077616e7420666f72206e6f7468696e673f", "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"),
    ("aa" * 20, "dd" * 50, "773ea91e36800e46854db8ebd09181a72959098b3ef8c122d9635514ced565fe"),
    ("aa" * 131, "54657374205573696e67204c6172676572205468616e20426c6f636b2d53697a65204b6579202d2048617368204b6579204669727374", "60e431591ee0b67f0d8a26aacbf5b77f8e0bc6213728c5140546040f0ee37f54"),
)


@pytest.mark.parametrize(("key", "data", "want"), RFC4231)
def test_rfc_4231(one, key, data, want):
    assert one(F.lower(F.hex(keyed.hmac(F.unhex("d"), bytes.fromhex(key)))), d=data) == want
    assert one(F.lower(F.hex(keyed.hmac(F.unhex("d"), F.unhex("k")))), d=data, k=key) == want
    wide = hmac.new(bytes.fromhex(key), bytes.fromhex(data), "sha512").hexdigest()
    assert one(F.lower(F.hex(keyed.hmac(F.unhex("d"), F.unhex("k"), 512))), d=data, k=key) == wide


# Fixed values of RFC 5869 (cases 1 and 3): secret, salt, info, length, key.
@pytest.mark.parametrize(("secret", "salt", "info", "length", "want"), [
    ("0b" * 22, "000102030405060708090a0b0c", "f0f1f2f3f4f5f6f7f8f9", 42, "3cb25f25faacd57a90434f64d0362f2a2d2d0a90cf1a5a4c5db02d56ecc4c5bf34007208d5b887185865"),
    ("0b" * 22, "", "", 42, "8da4e775a563c18f715f802a063c5a31b8a11f5c5ee1879ec3454e5f3c738d2d9d201395faa4b61a96c8"),
])
def test_rfc_5869(one, secret, salt, info, length, want):
    assert one(F.lower(F.hex(keyed.hkdf(bytes.fromhex(secret), F.unhex("i"), length, bytes.fromhex(salt)))), i=info) == want


def test_hash_and_keys_by_type(spark):
    df = spark.createDataFrame([("Ann ü", "name"), ("Ann ü", "email"), (None, "name")], "v string, k string")
    key = "sixteen-byte-salt"
    got = df.select(tokens.tagged_hash(F.col("v"), "hmac-sha256", key).alias("h"), tokens.tagged_hash(F.col("v"), "hmac-sha512", key).alias("w")).collect()
    assert got[0].h == "hmac-sha256:" + hmac.new(key.encode(), "Ann ü".encode(), hashlib.sha256).hexdigest() and got[2].h is None
    assert got[0].w == "hmac-sha512:" + hmac.new(key.encode(), "Ann ü".encode(), hashlib.sha512).hexdigest()
    sealed = df.withColumn("s", tokens.encrypt(F.col("v"), "secret", F.col("k"), True, True)).withColumn("r", tokens.encrypt(F.col("v"), "secret", F.col("k"), False, True))
    back = sealed.select("v", "s", tokens.decrypt(F.col("s"), "secret", F.col("k"), derive=True).alias("a"), tokens.decrypt(F.col("r"), "secret", F.col("k"), derive=True).alias("b"), tokens.decrypt(F.col("s"), "secret", F.lit("other"), False, True).alias("c"))
    rows = back.collect()
    assert all(r.a == r.b == r.v and r.c is None for r in rows) and rows[0].s != rows[1].s
    assert "Python" not in back._jdf.queryExecution().executedPlan().toString()


def test_operators_with_derived_keys(one):
    ops = {"name": anon.Operator("encrypt", {"key": "k", "derive": True}), "email": anon.Operator("hash", {"algorithm": "hmac-sha256", "salt": "sixteen-byte-salt"})}
    spans = F.array(*[F.struct(F.lit(k).alias("entity_type"), F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(1.0).alias("score")) for k, a, b in (("name", 0, 3), ("email", 4, 10))])
    done = one(anon.anonymize(F.col("t"), spans, ops, "none"), t="Ann a@b.co")
    assert done["text"].endswith(hmac.new(b"sixteen-byte-salt", b"a@b.co", hashlib.sha256).hexdigest())
    with pytest.raises(ValueError, match="needs a salt"):
        anon.validate({"x": anon.Operator("hash", {"algorithm": "hmac-sha256"})})
    with pytest.raises(ValueError):
        keyed.hmac(F.lit("x"), b"k", 384)
    with pytest.raises(ValueError):
        keyed.hkdf(b"k", F.lit("x"), 9000)

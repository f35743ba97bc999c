"""Provider tokens, JSON web tokens and session ids; hashes, ciphers and their text forms."""

from __future__ import annotations

import hashlib
import hmac as _hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import keyed
from .detect import matches
from .patterns import SECRET_TYPES, TOKENS

JWT_ALGORITHMS = ("HS256", "HS384", "HS512", "RS256", "RS384", "RS512", "ES256", "ES384", "ES512", "PS256", "PS384", "PS512", "EdDSA", "none")


def token_type(value: Column) -> Column:
    """The first provider, in order, whose format the whole value has; null if none."""
    return F.coalesce(*[F.when(matches(value, t.name), t.name) for t in TOKENS], F.lit(None).cast("string"))


def token_types(text: Column) -> Column:
    """Distinct token types of a text's words, trimmed of punctuation, in order of appearance."""
    words = F.transform(F.split(text, r"\s+"), lambda w: F.regexp_replace(w, r"^[^A-Za-z0-9_.=-]+|[^A-Za-z0-9_.=-]+$", ""))
    return F.array_distinct(F.array_compact(F.transform(F.filter(words, lambda w: F.length(w) >= 12), token_type)))


def jwt_header(value: Column) -> Column:
    part = F.translate(F.substring_index(value, ".", 1), "-_", "+/")
    padded = F.concat(part, F.repeat(F.lit("="), F.pmod(-F.length(part), F.lit(4))))
    return F.when(value.rlike(r"^[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*$"), F.try_to_binary(padded, F.lit("base64")).cast("string"))


def jwt_algorithm(value: Column) -> Column:
    found = F.get_json_object(jwt_header(value), "$.alg")
    return F.when(found.isin(*JWT_ALGORITHMS), found)


def is_session_id(value: Column) -> Column:
    """At least 20 bytes, letters and digits, and over half of the characters different."""
    unique = F.size(F.array_distinct(F.split(value, "")))
    return (F.octet_length(value) >= 20) & value.rlike("[A-Za-z]") & value.rlike("[0-9]") & ~value.rlike(r"\s") & (unique / F.octet_length(value) > 0.5)


def mask_token(value: Column) -> Column:
    """Prefix up to the last separator of the first twelve characters, then stars and the last four."""
    prefix = F.regexp_extract(value, r"^([A-Za-z0-9]{2,8}[_.-](?:live_|test_)?)", 1)
    return F.when(F.length(value) < 12, F.lit("****")).otherwise(F.concat(prefix, F.lit("****"), F.right(value, F.lit(4))))


def tagged_hash(value: Column, algorithm: str = "sha256", salt: str = "") -> Column:
    """`tag:hex` of salt and value. sha256, sha512, hmac-sha256 and hmac-sha512 (the salt is their key) are expressions;
    hmac-sha3-256 and blake2b run in Arrow. Others are not available here and raise."""
    salted = F.concat(F.lit(salt), value)
    if algorithm in ("sha256", "sha512"):
        return F.concat(F.lit(f"{algorithm}:"), F.sha2(salted, int(algorithm[3:])))
    if algorithm in ("hmac-sha256", "hmac-sha512"):
        return F.concat(F.lit(f"{algorithm}:"), F.lower(F.hex(keyed.hmac(value, salt.encode(), int(algorithm[8:])))))
    if algorithm == "hmac-sha3-256":
        digest = lambda t: "hmac-sha3-256:" + _hmac.new(salt.encode(), t.encode(), hashlib.sha3_256).hexdigest()
    elif algorithm == "blake2b":
        digest = lambda t: "blake2b:" + hashlib.blake2b((salt + t).encode(), digest_size=32).hexdigest()
    else:
        raise ValueError(f"hash {algorithm!r} is not supported; there are sha256, sha512, hmac-sha256, hmac-sha512, hmac-sha3-256 and blake2b")

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(digest, na_action="ignore")

    return run(value)


def is_secret_type(kind: Column) -> Column:
    return kind.isin(*sorted(SECRET_TYPES))


#: What keys by entity type are derived for.
PURPOSE = "sparkveil aead "


def _key(key: str, entity_type: Column, derive: bool) -> Column:
    """The 32 bytes of a cipher's key: the hash of `key`, or one derived from it for each entity type."""
    return keyed.hkdf(key.encode(), F.concat(F.lit(PURPOSE), entity_type)) if derive else F.unhex(F.sha2(F.lit(key), 256))


def encrypt(value: Column, key: str, entity_type: Column, deterministic: bool = False, derive: bool = False) -> Column:
    """AES-GCM, base64, bound to the entity type. Deterministic: the nonce comes from the value, so that
    equal values stay equal. With `derive` each entity type has a key of its own (HKDF), and a deterministic nonce is
    an HMAC under it."""
    k, aad = _key(key, entity_type, derive), entity_type.cast("binary")
    if deterministic:
        named = F.concat(entity_type, F.lit("|"), value)
        nonce = F.substring(keyed.hmac(named, k), 1, 12) if derive else F.unhex(F.substring(F.sha2(F.concat(F.lit(key), F.lit("|"), named), 256), 1, 24))
        return F.base64(F.aes_encrypt(value.cast("binary"), k, F.lit("GCM"), F.lit("DEFAULT"), nonce, aad))
    return F.base64(F.aes_encrypt(value.cast("binary"), k, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), aad))


def decrypt(value: Column, key: str, entity_type: Column, strict: bool = True, derive: bool = False) -> Column:
    """Inverse of `encrypt`; a value that doesn't authenticate raises, or gives null unless `strict`."""
    k, aad = _key(key, entity_type, derive), entity_type.cast("binary")
    run = F.aes_decrypt if strict else F.try_aes_decrypt
    return run(F.unbase64(value), k, F.lit("GCM"), F.lit("DEFAULT"), aad).cast("string")

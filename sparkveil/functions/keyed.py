"""Keyed hashes and derived keys as expressions: HMAC with SHA-2 and HKDF on it (RFC 2104, RFC 5869), all in the JVM.

A key that is known when the query is built is padded on the driver; one that is a column, as keys derived by entity type
are, is padded by expressions on its hexadecimal digits.
"""

from __future__ import annotations

import hashlib
import hmac as plain_hmac

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a block of each hash, and the two pads.
BLOCK = {256: 64, 512: 128}
INNER, OUTER = 0x36, 0x5C


def _sha(data: Column, bits: int) -> Column:
    return F.unhex(F.sha2(data, bits))


def _masked(digits: Column, mask: int, bits: int) -> Column:
    """The bytes of hexadecimal digits, filled up to a block, each combined with `mask`."""
    full = F.rpad(digits, 2 * BLOCK[bits], "0")
    one = lambda i: F.lpad(F.hex(F.conv(F.substring(full, i, F.lit(2)), 16, 10).cast("int").bitwiseXOR(F.lit(mask))), 2, "0")
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(2 * BLOCK[bits] - 1), F.lit(2)), one), ""))


def _pads(key: bytes | Column, bits: int) -> tuple[Column, Column]:
    if isinstance(key, bytes):
        short = key if len(key) <= BLOCK[bits] else hashlib.new(f"sha{bits}", key).digest()
        full = short.ljust(BLOCK[bits], b"\0")
        return F.lit(bytes(b ^ INNER for b in full)), F.lit(bytes(b ^ OUTER for b in full))
    digits = F.when(F.octet_length(key) > BLOCK[bits], F.sha2(key, bits)).otherwise(F.hex(key))
    return _masked(digits, INNER, bits), _masked(digits, OUTER, bits)


def hmac(message: Column, key: bytes | Column, bits: int = 256) -> Column:
    """HMAC of a message (text counts as UTF-8) with SHA-256 or SHA-512, as bytes; null where message or key is."""
    if bits not in BLOCK:
        raise ValueError(f"no HMAC with SHA-{bits}; there are {sorted(BLOCK)}")
    inner, outer = _pads(key, bits)
    return _sha(F.concat(outer, _sha(F.concat(inner, message.cast("binary")), bits)), bits)


def hkdf(secret: bytes, info: Column, length: int = 32, salt: bytes = b"", bits: int = 256) -> Column:
    """`length` bytes of key for each value of `info`, derived from one secret. What doesn't depend on a row is done once, on
    the driver, and only its result is part of the plan, not the secret."""
    size = bits // 8
    if not 0 < length <= 255 * size:
        raise ValueError(f"HKDF gives 1 to {255 * size} bytes")
    extracted = plain_hmac.new(salt or bytes(size), secret, f"sha{bits}").digest()
    parts: list[Column] = []
    for i in range(1, -(-length // size) + 1):
        parts.append(hmac(F.concat(*parts[-1:], info.cast("binary"), F.lit(bytes([i]))), extracted, bits))
    return F.substring(F.concat(*parts), 1, length)

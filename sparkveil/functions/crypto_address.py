"""Checksums of cryptocurrency addresses: Base58Check, Bech32 and mixed-case hexadecimal.

They need big integers and hashes that have no expression form, so they run in Arrow batches, on the
few values that a pattern has found.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the formats.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
GENERATORS = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
MASK = (1 << 64) - 1


def base58check(value: str) -> bool:
    n = 0
    for c in value:
        if c not in BASE58:
            return False
        n = n * 58 + BASE58.index(c)
    zeros = len(value) - len(value.lstrip("1"))
    raw = bytes(zeros) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return len(raw) == 25 and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def bech32(value: str) -> bool:
    """Segwit addresses of either checksum constant."""
    if value not in (value.lower(), value.upper()):
        return False
    human, one, data = value.lower().rpartition("1")
    if not one or not human or len(data) < 6 or any(c not in BECH32 for c in data):
        return False
    check = 1
    for v in [*(ord(c) >> 5 for c in human), 0, *(ord(c) & 31 for c in human), *(BECH32.index(c) for c in data)]:
        top = check >> 25
        check = (check & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate(GENERATORS):
            check ^= g if top >> i & 1 else 0
    return check in (1, 0x2BC830A3)


def _rotated(x: int, n: int) -> int:
    return (x << n | x >> (64 - n)) & MASK if n else x


def keccak256(data: bytes) -> bytes:
    """The original Keccak with padding byte 1, which hashlib lacks. Offsets and round constants are made
    from their rules."""
    offsets, x, y = [[0] * 5 for _ in range(5)], 1, 0
    for t in range(24):
        offsets[x][y] = (t + 1) * (t + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5
    constants, lfsr = [], 1
    for _ in range(24):
        c = 0
        for j in range(7):
            if lfsr & 1:
                c |= 1 << ((1 << j) - 1)
            lfsr = lfsr << 1 ^ (0x171 if lfsr & 0x80 else 0)
        constants.append(c)
    rate = 136
    padded = bytearray(data) + b"\x01" + bytes(-(len(data) + 2) % rate) + b"\x80" if (len(data) + 1) % rate else bytearray(data) + b"\x81"
    a = [[0] * 5 for _ in range(5)]
    for start in range(0, len(padded), rate):
        for i in range(rate // 8):
            a[i % 5][i // 5] ^= int.from_bytes(padded[start + 8 * i : start + 8 * i + 8], "little")
        for c in constants:
            col = [a[x][0] ^ a[x][1] ^ a[x][2] ^ a[x][3] ^ a[x][4] for x in range(5)]
            a = [[a[x][y] ^ col[(x - 1) % 5] ^ _rotated(col[(x + 1) % 5], 1) for y in range(5)] for x in range(5)]
            b = [[0] * 5 for _ in range(5)]
            for x in range(5):
                for y in range(5):
                    b[y][(2 * x + 3 * y) % 5] = _rotated(a[x][y], offsets[x][y])
            a = [[b[x][y] ^ (~b[(x + 1) % 5][y] & MASK & b[(x + 2) % 5][y]) for y in range(5)] for x in range(5)]
            a[0][0] ^= c
    return b"".join(a[i % 5][i // 5].to_bytes(8, "little") for i in range(4))


def eip55(value: str) -> bool:
    """All lower or all upper case carries no checksum and passes."""
    body = value[2:]
    if not value.startswith("0x") or len(body) != 40 or any(c not in "0123456789abcdefABCDEF" for c in body):
        return False
    if body in (body.lower(), body.upper()):
        return True
    digest = keccak256(body.lower().encode()).hex()
    return all(c == (c.upper() if int(d, 16) > 7 else c.lower()) for c, d in zip(body, digest, strict=False))


def is_valid(value: str) -> bool:
    return eip55(value) if value.startswith("0x") else bech32(value) if value.lower().startswith("bc1") else base58check(value)


def crypto_address(value: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return s.map(is_valid, na_action="ignore")

    return run(value)

"""Hash families: where a term's bits lie in a signature."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MASK = (1 << 64) - 1
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def _rotate(x: int, r: int) -> int:
    return ((x << r) | (x >> (64 - r))) & _MASK


def _unshift(x: int, r: int) -> int:
    """The y with y ^ (y >> r) = x."""
    y = x
    for _ in range(64 // r + 1):
        y = x ^ (y >> r)
    return y


def seed_literal(seed: int) -> int:
    """The BIGINT whose hash under Spark's fixed seed 42 is `seed`.

    Spark hands the hash of one column on as the seed of the next. For one BIGINT, XXH64 is a
    bijection, which is run backwards here; so xxhash64(lit(seed_literal(j)), x) is XXH64 of x seeded with j.
    """
    h = _unshift(seed & _MASK, 32)
    h = h * pow(_P3, -1, 1 << 64) & _MASK
    h = _unshift(h, 29)
    h = h * pow(_P2, -1, 1 << 64) & _MASK
    h = _unshift(h, 33)
    h = (h - _P4) * pow(_P1, -1, 1 << 64) & _MASK
    h = _rotate(h, 64 - 27) ^ ((42 + _P5 + 8) & _MASK)
    h = h * pow(_P1, -1, 1 << 64) & _MASK
    value = _rotate(h, 64 - 31) * pow(_P2, -1, 1 << 64) & _MASK
    return value - (1 << 64) if value >> 63 else value


def unsigned_mod(h: Column, m: Column) -> Column:
    """h modulo m with h read as an unsigned 64-bit number."""
    half = F.shiftrightunsigned(h, 1) % m
    return F.when(h >= 0, h % m).otherwise((half * 2 + h.bitwiseAND(F.lit(1))) % m)


def term_row(term: Column, j: int, size: Column, family: str = "xxh64") -> Column:
    """Position of hash j of a term in a signature of `size` bits.

    xxh64 is XXH64 seeded with j. md5_60, the first 60 bits of md5("j:" + term), is one that SQL engines share.
    """
    if family == "xxh64":
        return unsigned_mod(F.xxhash64(F.lit(seed_literal(j)), term), size)
    if family == "md5_60":
        salted = F.concat(F.lit(f"{j}:").cast("binary"), term)
        return F.conv(F.substring(F.md5(salted), 1, 15), 16, 10).cast("bigint") % size
    raise ValueError(f"unknown hash family {family!r}")

"""Sizes of signatures, as numbers and as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def size_ratio(num_hashes: int, rate: float) -> float:
    """Bits per term."""
    return -num_hashes / math.log(1 - rate ** (1 / num_hashes))


def signature_size(terms: int, num_hashes: int, rate: float) -> int:
    return math.ceil(terms * size_ratio(num_hashes, rate))


def set_bit_ratio(size: int, num_hashes: int, rate: float) -> float:
    """Share of bits set in a full signature."""
    return 1 - (1 - 1 / size) ** (num_hashes * size / size_ratio(num_hashes, rate))


def size_ratio_col(num_hashes: Column, rate: Column) -> Column:
    return -num_hashes / F.log(1 - F.pow(rate, 1 / num_hashes))


def signature_size_col(terms: Column, num_hashes: int, rate: float) -> Column:
    return F.ceil(terms.cast("double") * F.lit(size_ratio(num_hashes, rate))).cast("bigint")


def page_size(num_docs: int) -> int:
    """Default page size in bytes: the root of a byte-wide row's length, as a power of two from 8 to 4096."""
    root = math.isqrt(num_docs // 8)
    power = 1 if root <= 1 else 1 << (root - 1).bit_length()
    return min(4096, max(8, power))


def set_bit_ratio_col(size: Column, num_hashes: int, rate: float) -> Column:
    return 1 - F.pow(1 - 1 / size, size * (num_hashes / size_ratio(num_hashes, rate)))


def page_size_col(num_docs: Column) -> Column:
    root = F.floor(F.sqrt(F.floor(num_docs / 8)))
    power = F.when(root <= 1, 1).otherwise(F.pow(F.lit(2), F.ceil(F.log2(root))))
    return F.least(F.lit(4096), F.greatest(F.lit(8), power)).cast("bigint")


def parameters(terms: int, num_hashes: int, rate: float) -> dict[str, float]:
    """The ratio alone for 0 terms; else bits and bytes of a signature as well."""
    out = {"ratio": size_ratio(num_hashes, rate)}
    if terms:
        bits = signature_size(terms, num_hashes, rate)
        out |= {"signature_size": bits, "signature_bytes": bits // 8}
    return out

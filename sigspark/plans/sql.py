"""The engine from SQL text: functions and views."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from sigspark.plans.index import read

_COMPLEMENT = bytes.maketrans(b"ACGT", b"TGCA")
_VALID = bytes(b if b in b"ACGT" else 0 for b in range(256))


def canonical(term: bytes) -> tuple[bytes, bool]:
    """The canonical form of one term, and whether it has only A, C, G and T."""
    f = term.translate(_VALID)
    r = f.translate(_COMPLEMENT)[::-1]
    half = len(f) // 2
    return (r if r[:half] < f[:half] else f), 0 not in f


@udtf(returnType="pos: bigint, term: binary")
class Kmers:
    def eval(self, text: str, k: int) -> Iterator[tuple[int, bytes]]:
        raw = (text or "").encode()
        for i in range(len(raw) - k + 1):
            yield i, raw[i : i + k]


def register(spark: SparkSession, **indices: str) -> None:
    """kmers(text, k) as a table function; for each name=path the views name_docs, name_pages and name_bits."""
    spark.udtf.register("kmers", Kmers)
    for name, path in indices.items():
        tables = read(spark, path)
        for part in ("docs", "pages", "bits"):
            getattr(tables, part).createOrReplaceTempView(f"{name}_{part}")

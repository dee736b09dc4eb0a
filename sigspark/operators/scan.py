"""Indices that aren't stored, scored and counted a document at a time.

A document's signature needs its own text alone: its rows are made, compared with those of the queries' windows, and
dropped again. So neither terms nor bits travel, only scores that count. What is built is the same index: sizes,
pages and hashes are those of build.py.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.functions import kernels
from sigspark.model import ClassicParams, CompactParams
from sigspark.operators.counting import runs
from sigspark.plans.storage import bound_batches

#: Bytes of sequences that are hashed at once.
HELD = 1 << 21
#: Rows of a signature up to which a number is kept for each of them.
DENSE = 1 << 24
_KEYS = ["path", "subdoc_index", "page_id", "signature_size"]


@dataclass(frozen=True)
class Source:
    """What an index is built from. size: that of the signatures, if all have one; single: whether every document is one segment."""

    segments: DataFrame
    docs: DataFrame
    pages: DataFrame
    params: ClassicParams | CompactParams
    size: int | None
    single: bool

    def rows(self) -> DataFrame:
        """path, subdoc_index, page_id, signature_size, seq; the segments of a document side by side."""
        spark = self.segments.sparkSession
        bound_batches(spark)
        some = self.segments.where("seq is not null").select("path", "subdoc_index", "seq")
        if self.size is not None:
            out = some.withColumns({"page_id": F.lit(0), "signature_size": F.lit(self.size).cast("bigint")})
        else:
            out = some.join(self.docs.join(self.pages, "page_id").select("path", "subdoc_index", "page_id", "signature_size"), ["path", "subdoc_index"])
        out = out.select(*_KEYS, "seq")
        if self.single:
            return out
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        return out.repartition(parts, "path", "subdoc_index").sortWithinPartitions("path", "subdoc_index")


def _pieces(parts: list[np.ndarray], k: int) -> Iterator[np.ndarray]:
    """Sequences, long ones in pieces that overlap by less than a window."""
    for p in parts:
        for a in range(0, max(1, len(p) - k + 1), HELD):
            yield p[a : a + HELD + k - 1]


def _hashed(pieces: list[np.ndarray], params: ClassicParams | CompactParams) -> list[list[np.ndarray]]:
    """For each piece, each hash of its windows."""
    k = params.term_size
    if params.canonicalize:
        buf, places, _, _ = kernels.strands(pieces, k)
        n = [max(0, len(p) - k + 1) for p in pieces]
        begin = np.cumsum([0, *n])[:-1]
    else:
        buf, places = np.concatenate([*pieces, np.zeros(kernels.PAD, np.uint8)]), None
        n = [max(0, len(p) - k + 1) for p in pieces]
        begin = np.cumsum([0, *(len(p) for p in pieces)])[:-1]
    found = [kernels.hashes(buf, k, j, params.family, places) for j in range(params.num_hashes)]
    return [[h[a : a + c] for h in found] for a, c in zip(begin, n)]


class _Marks:
    """Different numbers among those below a size, without sorting them."""

    def __init__(self) -> None:
        self.mark = np.zeros(0, np.int32)

    def distinct(self, rows: np.ndarray, size: int) -> np.ndarray:
        if size > DENSE:
            return np.unique(rows)
        if len(self.mark) < size:
            self.mark = np.zeros(size, np.int32)
        own = np.arange(len(rows), dtype=np.int32)
        self.mark[rows] = own
        return rows[self.mark[rows] == own]


def signatures(batches: Iterator[pa.RecordBatch], params: ClassicParams | CompactParams) -> Iterator[tuple[tuple, np.ndarray]]:
    """(path, subdoc_index, page_id, signature_size) of each document and the rows of its signature that have a bit, each once."""
    marks, held, size = _Marks(), [], 0

    def done(docs: list) -> Iterator[tuple[tuple, np.ndarray]]:
        flat = [p for _, own in docs for p in own]
        hashed = iter(_hashed(flat, params))
        for key, own in docs:
            rows = [kernels.modulo(h, key[3]) for _ in own for h in next(hashed)]
            yield key, marks.distinct(np.concatenate(rows) if rows else np.empty(0, np.int64), key[3])

    for key, parts in runs(batches, 4):
        own = list(_pieces(parts, params.term_size))
        if sum(map(len, own)) > 2 * HELD:  # a long document goes piece by piece
            some = [marks.distinct(np.concatenate([kernels.modulo(h, key[3]) for h in _hashed([p], params)[0]]), key[3]) for p in own]
            yield key, marks.distinct(np.concatenate(some), key[3])
            continue
        held.append((key, own))
        size += sum(map(len, own))
        if size >= HELD:
            yield from done(held)
            held, size = [], 0
    if held:
        yield from done(held)


class _Asked:
    """Queries' windows against signatures."""

    def __init__(self, seqs: list[bytes], owners: list[int], params: ClassicParams | CompactParams):
        hashed = _hashed([np.frombuffer(s, np.uint8) for s in seqs], params) if seqs else []
        n = np.array([len(h[0]) for h in hashed], np.int64)
        self.owner = np.repeat(np.array(owners, np.int64), n)
        self.hashes = [np.concatenate([np.empty(0, np.uint64), *(h[j] for h in hashed)]) for j in range(params.num_hashes)]
        self.queries = max(owners, default=-1) + 1
        self.size, self.there = 0, np.zeros(0, bool)

    def _of(self, size: int) -> list[np.ndarray]:
        if size != self.size:
            self.size, self.rows, self.sorted = size, [kernels.modulo(h, size) for h in self.hashes], None
        return self.rows

    def scores(self, signature: np.ndarray, size: int, shared: bool) -> np.ndarray:
        """For each query the number of windows whose rows are all in the signature; shared: whether all signatures have this size."""
        rows = self._of(size)
        if len(self.there) < size:
            self.there = np.zeros(size, bool)
        self.there[signature] = True
        if shared and len(signature) < len(self.owner):  # from the signature to the windows
            if self.sorted is None:
                order = np.argsort(rows[0], kind="stable")
                touched, first, count = np.unique(rows[0][order], return_index=True, return_counts=True)
                self.number = np.full(size, -1, np.int32)
                self.number[touched] = np.arange(len(touched))
                self.sorted = order, first, count
            order, first, count = self.sorted
            number = self.number[signature]
            number = number[number >= 0]
            begin, n = first[number], count[number]
            found = order[np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)]
        else:
            found = np.flatnonzero(self.there[rows[0]])
        for more in rows[1:]:
            found = found[self.there[more[found]]]
        self.there[signature] = False
        return np.bincount(self.owner[found], minlength=self.queries)


def scores(source: Source, queries: list[tuple[int, bytes]], least: list[int]) -> DataFrame:
    """path, subdoc_index, query, score of the pairs that have a score of at least 1 and `least` of the query's number."""
    params, shared = source.params, source.size is not None
    bound = np.maximum(1, np.array(least, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = _Asked([q for _, q in queries], [n for n, _ in queries], params)
        held: list[tuple] = []

        def made() -> pa.RecordBatch:
            n = [len(q) for _, _, q, _ in held]
            columns = [pa.array(np.repeat(np.array([h[0] for h in held], object), n), pa.string()), pa.array(np.repeat([h[1] for h in held], n), pa.int32()), pa.array(np.concatenate([h[2] for h in held]), pa.int64()), pa.array(np.concatenate([h[3] for h in held]), pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["path", "subdoc_index", "query", "score"])

        rows = 0
        for (path, subdoc, _, size), signature in signatures(batches, params):
            found = asked.scores(signature, size, shared)
            kept = np.flatnonzero(found >= bound[: len(found)])
            if len(kept):
                held.append((path, subdoc, kept, found[kept]))
                rows += len(kept)
                if rows > 50_000:
                    yield made()
                    rows = 0
        if held:
            yield made()

    return source.rows().mapInArrow(run, "path string, subdoc_index int, query bigint, score bigint")


def score_counts(source: Source, queries: list[tuple[int, bytes]]) -> DataFrame:
    """score, pairs: how many pairs of a query and a document have each score from 1 on; to be added up."""
    params, shared = source.params, source.size is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = _Asked([q for _, q in queries], [n for n, _ in queries], params)
        total = np.zeros(len(asked.owner) + 1, np.int64)
        for (_, _, _, size), signature in signatures(batches, params):
            total += np.bincount(asked.scores(signature, size, shared), minlength=len(total))
        some = np.flatnonzero(total[1:]) + 1
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["score", "pairs"])

    return source.rows().mapInArrow(run, "score bigint, pairs bigint")


def _summed(source: Source, name: str, by_row: bool) -> DataFrame:
    params, size = source.params, source.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(keys, values) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.int64())], [name, "ones"])

        dense = by_row and size is not None and size <= DENSE
        total, pages = np.zeros(size if dense else 0, np.int64), {}
        for (_, _, page, _), signature in signatures(batches, params):
            if dense:
                total[signature] += 1
            elif by_row:
                yield made(signature, np.ones(len(signature), np.int64))
            else:
                pages[page] = pages.get(page, 0) + len(signature)
        if dense:
            some = np.flatnonzero(total)
            yield made(some, total[some])
        elif pages:
            yield made(list(pages), list(pages.values()))

    return source.rows().mapInArrow(run, f"{name} bigint, ones bigint").groupBy(name).agg(F.sum("ones").cast("bigint").alias("ones"))


def row_ones(source: Source) -> DataFrame:
    """row_idx, ones: how many documents have a bit in each row of a classic index; rows without one are absent."""
    return _summed(source, "row_idx", True)


def page_ones(source: Source) -> DataFrame:
    """page_id, ones: set bits of each page that has one."""
    return _summed(source, "page_id", False).withColumn("page_id", F.col("page_id").cast("int"))

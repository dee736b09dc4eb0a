"""Benchmark decontamination by Wu-Manber multi-pattern search.

Test strings are all windows of `words` words of every benchmark item (the whole item where it
is shorter). With m the length of the shortest, a table gives for the hash of a block of bytes, 8 where
m allows it, how far the search may jump from a window of m bytes that ends with it: blocks in no
test string jump m - 7 bytes. Where the jump is 0, the test strings that have this block as
the last of their first m bytes are looked up by its value and compared directly.

Numpy moves one position in each of thousands of pieces of text at a time. Short test strings, which
allow short jumps only, have tables of their own, and test strings of more than `most` bytes are split into
groups with tables of their own. All tables are broadcast; the documents are read once for up to
`TABLES` groups, and once more for each as many.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.llm.common import free_name, table

BLOCK = 8
HASH_BITS = 18
#: Bytes up to which test strings are short.
SHORT = 24
TABLES = 4
PIECE = 4096
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Letters, digits and all longer characters stay; the rest is a space.
TABLE = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def normal(text: bytes | None) -> bytes:
    """Lower-cased UTF-8 as words between single spaces, with a space at both ends."""
    return b" %b " % b" ".join((text or b"").translate(TABLE).split())


def test_strings(item: bytes | None, words: int, least: int) -> list[bytes]:
    w = normal(item).split()
    if len(w) < max(least, 1):
        return []
    return sorted({b" %b " % b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))})


class WuManber:
    def __init__(self, owners: dict[bytes, list[int]]):
        """owners: numbers of the items that each test string comes from."""
        patterns = sorted(owners)
        self.m = min(map(len, patterns), default=0)
        self.joined, self.edges = b"".join(patterns), np.cumsum([0, *map(len, patterns)])
        self.owned, self.first_owner = np.array([i for p in patterns for i in owners[p]], np.int32), np.cumsum([0, *(len(owners[p]) for p in patterns)])
        size = min(BLOCK, self.m)
        jump = self.m - size + 1
        #: The bytes of a block, of the 8 that are read.
        self.mask, self.ahead = np.uint64((1 << 8 * size) - 1), self.m - size
        self.shift = np.full(1 << HASH_BITS, max(jump, 1), np.int32)
        if not patterns:
            return
        heads = np.zeros((len(patterns), self.m + BLOCK), np.uint8)
        heads[:, : self.m] = np.frombuffer(b"".join(p[: self.m] for p in patterns), np.uint8).reshape(-1, self.m)
        for at in range(jump):  # at: where the block begins; later blocks have smaller shifts
            block = np.ascontiguousarray(heads[:, at : at + BLOCK]).view("<u8").ravel() & self.mask
            self.shift[self.hash(block)] = jump - 1 - at
        last = np.ascontiguousarray(heads[:, jump - 1 : jump - 1 + BLOCK]).view("<u8").ravel() & self.mask
        self.order = np.argsort(last, kind="stable").astype(np.int32)
        self.suffixes, first = np.unique(last[self.order], return_index=True)
        self.bucket = np.r_[first, len(patterns)]

    def pattern(self, k: int) -> bytes:
        return self.joined[self.edges[k] : self.edges[k + 1]]

    def owners(self, k: int) -> list[int]:
        return self.owned[self.first_owner[k] : self.first_owner[k + 1]].tolist()

    @staticmethod
    def hash(block: np.ndarray) -> np.ndarray:
        return ((block * MULTIPLIER) >> np.uint64(64 - HASH_BITS)).astype(np.int64)

    def search(self, text: bytes) -> Iterator[tuple[int, int]]:
        """(position, pattern number) of every occurrence."""
        if not self.joined or len(text) < self.m:
            return
        blocks = np.ndarray((len(text),), "<u8", text + bytes(BLOCK), strides=(1,))
        start = np.arange(0, len(text) - self.m + 1, PIECE)
        stop = np.minimum(start + PIECE, len(text) - self.m + 1)
        while len(start):
            block = blocks[start + self.ahead] & self.mask
            shift = self.shift[self.hash(block)]
            hit = np.flatnonzero(shift == 0)
            if len(hit):
                which = np.minimum(np.searchsorted(self.suffixes, block[hit]), len(self.suffixes) - 1)
                same = self.suffixes[which] == block[hit]
                for at, b in zip(start[hit[same]].tolist(), which[same].tolist()):
                    for k in self.order[self.bucket[b] : self.bucket[b + 1]].tolist():
                        if text.startswith(self.pattern(k), at):
                            yield at, k
            start = start + np.maximum(shift, 1)
            live = start < stop
            if not live.all():
                start, stop = start[live], stop[live]

    def search_all(self, texts: list[bytes], limit: int = 8 << 20) -> Iterator[tuple[int, int]]:
        """(text number, pattern number) of every occurrence in normal texts.

        Texts are joined; two spaces part them, which no test string has.
        """
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= limit):
                size += len(texts[end])
                end += 1
            edges = np.cumsum([0, *map(len, texts[at:end])])
            found = list(self.search(b"".join(texts[at:end])))
            if found:
                where = np.searchsorted(edges, [p for p, _ in found], "right") - 1
                yield from zip((where + at).tolist(), [k for _, k in found])
            at = end


def _groups(benchmark: DataFrame, words: int, least: int, most: int) -> list[tuple[WuManber, pa.Array]]:
    """Search tables with their items' ids, for groups of items of about `most` bytes of test strings."""
    items = benchmark.where("text is not null").select("item_id", F.lower("text").alias("text")).distinct()
    size = (items.agg(F.sum(F.octet_length("text").cast("bigint") * words)).first()[0] or 0) // 5
    n = size // most + 1
    out = []
    for g in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == g).orderBy("item_id", "text").toArrow()
        ids, numbers, owners = [], {}, ({}, {})
        for item, text in zip(rows.column("item_id").to_pylist(), rows.column("text").to_pylist()):
            if item not in numbers:
                numbers[item] = len(ids)
                ids.append(item)
            for p in test_strings(text.encode(), words, least):
                own = owners[len(p) > SHORT].setdefault(p, [])
                if numbers[item] not in own:
                    own.append(numbers[item])
        kind = rows.schema.field("item_id").type
        out += [(WuManber(o), pa.array(ids, kind)) for o in owners if o]
    return out


def _normal_batch(column: pa.Array) -> list[bytes]:
    return [normal(t) for t in column.cast(pa.binary()).to_pylist()]


def leaks(docs: DataFrame, benchmark: DataFrame, words: int = 8, least: int = 1, most: int = 64 << 20) -> DataFrame:
    """doc_id, item_id, n_windows: how many different test strings of an item occur in a document.

    Case, punctuation and white space don't count. Items of fewer than `least` words, without a word or without
    text are not searched for; null and empty documents have no leak. A repeated document row
    reports again; rows with a null doc_id or item_id report it. An item_id with several texts has the
    windows of them all. Other columns are ignored; either table may be empty, and then there is no leak.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, n_windows bigint"
    lowered = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.lower("text").alias("text"))
    groups, parts = _groups(benchmark, words, least, most), []
    for g in range(0, len(groups), TABLES):
        sent = spark.sparkContext.broadcast(groups[g : g + TABLES])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = _normal_batch(batch.column(2))
                for machine, ids in sent.value:
                    counts: dict[tuple[int, int], int] = {}
                    for i, k in set(machine.search_all(texts)):
                        for item in machine.owners(k):
                            counts[i, item] = counts.get((i, item), 0) + 1
                    at = pa.array([i for i, _ in counts], pa.int64())
                    item = pa.array([j for _, j in counts], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), ids.take(item), pa.array(list(counts.values()), pa.int64())], ["doc_id", "row", "item_id", "n_windows"])

        parts.append(lowered.mapInArrow(run, schema.replace(", item_id", ", row bigint, item_id")))
    if not parts:
        return spark.createDataFrame([], schema)
    # an item may have test strings in several tables
    return reduce(DataFrame.unionByName, parts).groupBy("row", "doc_id", "item_id").agg(F.sum("n_windows").alias("n_windows")).drop("row")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, words: int = 8, least: int = 5, most: int = 64 << 20) -> DataFrame:
    """The rows of docs, with all their columns, in which no test string occurs.

    Items of fewer than `least` words are no ground for dropping a document: "new york" leaks nothing. Null and empty
    texts stay; repeated rows stay or go alike. An empty benchmark drops nothing; an empty table gives an empty result.
    """
    names, groups = docs.columns, _groups(benchmark, words, least, most)
    for g in range(0, len(groups), TABLES):
        sent = docs.sparkSession.sparkContext.broadcast([machine for machine, _ in groups[g : g + TABLES]])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean, texts = np.ones(batch.num_rows, bool), _normal_batch(batch.column(len(names)))
                for machine in sent.value:
                    clean[[i for i, _ in machine.search_all(texts)]] = False
                yield batch.filter(pa.array(clean)).select(list(range(len(names))))

        docs = docs.withColumn(free_name(names, "lowered"), F.lower("text")).mapInArrow(run, docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                  ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\x{80}-\x{10FFFF}]+', ' ', 'g')) || ' ' AS t FROM documents),
b AS (SELECT DISTINCT item_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9\x{80}-\x{10FFFF}]+', ' ', 'g')), ' ') AS w FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT DISTINCT item_id, ' ' || array_to_string(w[i:i + 7], ' ') || ' ' AS s
      FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 7) + 1)) AS i FROM b WHERE w <> ['']))
SELECT doc_id, item_id, count(*) AS n_windows FROM d JOIN p ON contains(d.t, p.s) GROUP BY rid, doc_id, item_id
"""

"""SimHash near-duplicates with pivot distance tables.

A fingerprint has 256 bits: bit j is 1 if more than half of a document's distinct words have
bit j of their MD5-based 256-bit hash set. Documents are near-duplicates if their fingerprints
differ in at most `RADIUS` bits; groups are the connected components. Equal fingerprints are
collapsed first.

Candidates are fingerprints that agree in a block of bits: random orders of the bits are cut into blocks of
b bits. b is log2 of the number of fingerprints less 4, but 16 at least, so that a bucket of unrelated
fingerprints stays at some 16; the number of orders grows with b so that all but one in `MISSED` pairs at random
differences of `RADIUS` bits share a block, see plan(). Work grows as n ** 1.25. Up to 2**20 fingerprints there are
8 orders of 16 blocks: fewer than 16 different bits leave a block of each order whole, so none of those pairs
is missed; of random pairs at 40 bits 1 to 10 of 20,000 in trials had no whole block, at 30 and at 35 bits none. As
planned for 10**8 fingerprints, 55 of 20,000 at 40 bits had none, 1 at 35.

In a bucket of more than `TOGETHER` fingerprints, the distances of all to some of them, the pivots, are tabulated
once, and rows near the same pivot are laid side by side in tiles. By the triangle inequality the gap between two
tiles' ranges of distances to a pivot bounds every distance between them from below, so that tiles more than the
radius apart are never compared. In other pairs of tiles, and in smaller buckets, all pairs are compared, half of
the bits first; tiles that lie in one component already are left out. In a bucket nothing is lost.
A sample of the fingerprints tells buckets of more than `HOT`; they are cut into chunks by a hash of the id, and
every two chunks meet on their own.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.llm.common import BLOB_SCHEMA, Packer, connected_components, exchange, materialize, mix, partitions, runs, signed, table, unpacked, with_numbers

try:
    from _md5 import md5  # without the set-up that OpenSSL does for each call
except ImportError:
    md5 = functools.partial(hashlib.md5, usedforsecurity=False)

WORDS = 4
RADIUS = 40
#: Rows of a large bucket from which the distances of all its rows are tabulated.
PIVOTS = 8
BITS = 64 * WORDS
#: One in so many pairs at the radius is missed.
MISSED = 1000
#: Bytes of records that a task holds.
HELD = 64 << 20
#: Fingerprints of a bucket that one task looks at together, but for as many again.
HOT = 1 << 20
#: Fingerprints of such a bucket that a sample has.
SIGNS = 64
#: Rows of a bucket up to which all its pairs are looked at together, and of a tile of larger ones.
TOGETHER = 256

#: Words beyond which a worker forgets the hashes of all it knows.
REMEMBERED = 150_000

SPLIT = bytes(b if b > 127 or chr(b).isdigit() or chr(b).islower() else 32 for b in range(256))
#: A byte's bits, the highest first, each in a byte of its own.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).reshape(256, 8).copy().view("<u8").ravel()

RECORD = np.dtype([("key", "<u8"), ("id", "<i8"), ("f", "<u8", (WORDS,))])


class Hasher:
    """Fingerprints of lower-cased texts; remembers the hashes of words."""

    def __init__(self):
        self.lanes = np.zeros((1024, 8 * WORDS), np.uint64)
        self.forget()

    def forget(self) -> None:
        #: Of each word; a new one gets the next number when it is looked up.
        self.numbers: dict[bytes, int] = defaultdict(itertools.count().__next__)

    def learn(self, sets: list[set[bytes]], n: int) -> np.ndarray:
        """Numbers of the n words of these sets, one after the other."""
        if len(self.numbers) > REMEMBERED:
            self.forget()
        start = len(self.numbers)
        ids = np.fromiter(map(self.numbers.__getitem__, itertools.chain.from_iterable(sets)), np.int64, n)
        end = len(self.numbers)
        if end > start:
            new = list(itertools.islice(reversed(self.numbers), end - start))
            raw = b"".join([md5(w).digest() for last in new for w in (last, b"+" + last)])
            while len(self.lanes) < end:
                self.lanes = np.concatenate([self.lanes, np.zeros_like(self.lanes)])
            self.lanes[start:end] = LANES[np.frombuffer(raw, np.uint8).reshape(len(new), -1)][::-1]
        return ids

    def fingerprints(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(n, 4) words, and whether a text has a word at all."""
        sets = [set((t or b"").translate(SPLIT).split()) for t in texts]
        sizes = np.array([len(s) for s in sets])
        out = np.zeros((len(texts), WORDS), np.uint64)
        at = 0
        while at < len(sets):  # about 50,000 words at a time
            end = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), 50_000)) + at)
            part, n = sets[at:end], sizes[at:end]
            ids = self.learn(part, int(n.sum()))
            counts = np.zeros((len(part), 64 * WORDS), np.int64)
            if len(ids):
                starts = np.r_[0, np.cumsum(n)[:-1]]
                # lanes hold 255 at most: sum in runs of that many words
                cuts = np.concatenate([np.arange(s, s + k, 255) for s, k in zip(starts, n) if k])
                owner = np.repeat(np.arange(len(part)), -(-n // 255))
                sums = np.add.reduceat(self.lanes[ids], cuts, axis=0).view(np.uint8).reshape(len(cuts), -1)
                first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                counts[owner[first]] = np.add.reduceat(sums, first, axis=0, dtype=np.int64)
            out[at:end] = np.packbits(2 * counts > n[:, None], axis=1).view(">u8").astype(np.uint64)
            at = end
        return out, sizes > 0


def plan(n: int) -> tuple[int, int]:
    """(bits of a block, orders) for n different fingerprints."""
    bits = max(16, math.ceil(math.log2(max(n, 2))) - 4)
    tables = math.log(MISSED) / -math.log1p(-((1 - RADIUS / BITS) ** bits))
    return bits, max(8, math.ceil(tables / (BITS // bits)))


@functools.cache
def order(number: int) -> np.ndarray:
    return np.random.default_rng([20240607, number]).permutation(BITS)


def block_keys(f: np.ndarray, orders: Iterable[int], size: int) -> Iterator[np.ndarray]:
    """A key for each whole block of `size` bits in each of these orders."""
    bits = np.unpackbits(np.ascontiguousarray(f).view(np.uint8).reshape(len(f), 8 * WORDS), axis=1)
    for s in orders:
        for t in range(BITS // size):
            block = np.zeros((len(f), 8), np.uint8)
            packed = np.packbits(bits[:, order(s)[t * size : (t + 1) * size]], axis=1)
            block[:, : packed.shape[1]] = packed
            yield mix(block.view(np.uint64).ravel() ^ mix(np.full(len(f), s * BITS + t + 1, np.uint64)))


def cells(keys: np.ndarray, ids: np.ndarray, hot: np.ndarray, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) with hot keys (sorted) replaced by a key for every pair of chunks that the row is in."""
    at = np.minimum(np.searchsorted(hot, keys), max(len(hot) - 1, 0))
    found = np.flatnonzero(hot[at] == keys) if len(hot) else np.zeros(0, np.int64)
    if not len(found):
        return np.arange(len(keys)), keys
    c = chunks[at[found]]
    mine = np.repeat((mix(ids[found].view(np.uint64)) % c.astype(np.uint64)).astype(np.int64), c)
    row, other = np.repeat(found, c), np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
    cell = np.minimum(mine, other) * (1 << 31) + np.maximum(mine, other) + 1
    rest = np.setdiff1d(np.arange(len(keys)), found)
    return np.r_[rest, row], np.r_[keys[rest], mix(keys[row] ^ mix(cell.astype(np.uint64)))]


def hot_keys(same: DataFrame, n: int, size: int, orders: int, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of buckets of more than about `hot` fingerprints, sorted, and numbers of chunks. They are few: at most 2 n / hot of a block."""
    if n <= hot:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    step = max(1, hot // SIGNS)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.stack([batch.column(w).to_numpy().view(np.uint64) for w in range(WORDS)], axis=1)
            for key in block_keys(f, range(orders), size):
                yield pa.RecordBatch.from_arrays([signed(key)], ["key"])

    some = same.where(F.pmod(F.xxhash64("rep"), F.lit(step)) == 0).select(*FINGERPRINT)
    found = some.mapInArrow(keys, "key bigint").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * 2 * step > hot).toArrow()
    key, count = found.column(0).to_numpy().astype(np.int64).view(np.uint64), found.column(1).to_numpy()
    order = np.argsort(key)
    return key[order], -(-count[order] * step // hot) + 1


def near(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x and of y that are within the radius."""
    half = np.bitwise_count(x[:, None, 0] ^ y[None, :, 0])
    half += np.bitwise_count(x[:, None, 1] ^ y[None, :, 1])
    a, b = np.divmod(np.flatnonzero(half.ravel() <= RADIUS), len(y))
    whole = np.bitwise_count(x[a] ^ y[b]).sum(1, dtype=np.int32) <= RADIUS
    return a[whole], b[whole]


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star of edges for each component of the graph."""
    if not len(a):
        return a, b
    names, at = np.unique(np.r_[a, b], return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(names))
    return names[other], names[label[other]]


def tiles(f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the rows, and for its tiles the least and the largest distance to each pivot.

    Pivots are rows that lie far from each other; rows of one nearest pivot come together, by their distance to it.
    """
    table = np.zeros((len(f), PIVOTS), np.int16)
    at = 0
    for p in range(PIVOTS):
        table[:, p] = np.bitwise_count(f ^ f[at]).sum(1, dtype=np.int16)
        at = int(table[:, : p + 1].min(1).argmax())
    nearest = table.argmin(1)
    order = np.lexsort((table[np.arange(len(f)), nearest], nearest))
    starts = np.arange(0, len(f), TOGETHER)
    return order, np.minimum.reduceat(table[order], starts), np.maximum.reduceat(table[order], starts)


def large_bucket(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what all close pairs join, without looking at tiles that can't touch or are joined already."""
    order, low, high = tiles(f)
    f, label = f[order], np.arange(len(f))
    for i in range(len(low)):
        first = slice(i * TOGETHER, (i + 1) * TOGETHER)
        apart = np.maximum(low[i] - high[i:], low[i:] - high[i]).max(1)
        for j in np.flatnonzero(apart <= RADIUS) + i:
            second = slice(j * TOGETHER, (j + 1) * TOGETHER)
            if (label[first] == label[second.start]).all() and (label[second] == label[second.start]).all():
                continue
            a, b = near(f[first], f[second])
            a, b = label[a + first.start], label[b + second.start]
            new = a != b
            if new.any():
                change = np.arange(len(f))
                names, root = spanning(a[new], b[new])
                change[names] = root
                label = change[label]
    other = np.flatnonzero(label != np.arange(len(f)))
    return order[other], order[label[other]]


def bucket_edges(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges between the ids of close records that share a key."""
    records = records[np.argsort(records["key"], kind="stable")]
    starts, ends = runs(records["key"])
    size = ends - starts
    out_a, out_b = [], []
    ids, f = records["id"], records["f"]
    for s, e in zip(starts[size > TOGETHER], ends[size > TOGETHER]):
        a, b = large_bucket(f[s:e])
        out_a.append(ids[s:e][a])
        out_b.append(ids[s:e][b])
    some = (size > 1) & (size <= TOGETHER)
    for k in np.unique(size[some]):
        first = starts[some & (size == k)]
        i, j = np.triu_indices(k, 1)
        step = max(1, (1 << 18) // len(i))
        for at in range(0, len(first), step):
            rows = first[at : at + step, None] + np.arange(k)
            g = f[rows, :2]
            half = np.bitwise_count(g[:, i, 0] ^ g[:, j, 0])
            half += np.bitwise_count(g[:, i, 1] ^ g[:, j, 1])
            bucket, pair = np.divmod(np.flatnonzero(half.ravel() <= RADIUS), len(i))
            a, b = rows[bucket, i[pair]], rows[bucket, j[pair]]
            hit = np.bitwise_count(f[a] ^ f[b]).sum(1, dtype=np.int32) <= RADIUS
            out_a.append(ids[a[hit]])
            out_b.append(ids[b[hit]])
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return spanning(np.concatenate(out_a), np.concatenate(out_b))


FINGERPRINT = [f"f{w}" for w in range(WORDS)]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and f0..f3 of the rows that have a doc_id and a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                b = batch.slice(at, 1000)
                f, some = hasher.fingerprints(b.column(1).cast(pa.binary()).to_pylist())
                keep = pa.array(some)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), *(signed(np.ascontiguousarray(f[some, w])) for w in range(WORDS))], ["doc_id", *FINGERPRINT])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} bigint" for c in FINGERPRINT)
    return docs.where("doc_id is not null and text is not null").select("doc_id", F.lower("text").alias("text")).mapInArrow(run, schema)


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, group_id (the least doc_id of the group), kept, for every document that has a near-duplicate.

    Texts that are null, empty or without a letter or digit, and rows with a null doc_id, have no
    near-duplicates. Rows that share a doc_id are one document: they are listed, each, only if another
    doc_id is in their group, and are kept together. Ids of any type that can be sorted will do. Other
    columns are ignored; an empty table gives an empty result.
    """
    return with_numbers(fingerprints(docs), "doc_id", _groups, "group_id")


def _groups(prints: DataFrame, hot: int = HOT) -> DataFrame:
    prints = materialize(prints)
    same = materialize(prints.groupBy(*FINGERPRINT).agg(F.min("doc_id").alias("rep")))
    n = same.count()
    size, orders = plan(n)
    #: Orders of bits whose buckets are gathered at once.
    at_once = max(1, 32 // (BITS // size))
    sent = prints.sparkSession.sparkContext.broadcast(hot_keys(same, n, size, orders, hot))
    parts = max(partitions(prints.sparkSession), -(-n * at_once * (BITS // size) * RECORD.itemsize // HELD))

    def spread(orders: range) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packer = Packer(parts)
            for batch in batches:
                f = np.stack([batch.column(w).to_numpy().view(np.uint64) for w in range(WORDS)], axis=1) if batch.num_rows else np.zeros((0, WORDS), np.uint64)
                ids = batch.column(WORDS).to_numpy()
                for key in block_keys(f, orders, size):
                    row, key = cells(key, ids, *sent.value)
                    r = np.zeros(len(row), RECORD)
                    r["key"], r["id"], r["f"] = key, ids[row], f[row]
                    yield from packer.add(key, r)
            yield from packer.flush()

        return run

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records in unpacked(batches, RECORD):
            a, b = bucket_edges(records)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    some = [range(s, min(s + at_once, orders)) for s in range(0, orders, at_once)]
    edges = [materialize(exchange(same.mapInArrow(spread(s), BLOB_SCHEMA), parts).mapInArrow(join, "a bigint, b bigint")) for s in some]
    roots = connected_components(functools.reduce(DataFrame.unionByName, edges))
    within = prints.join(same, FINGERPRINT).join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    named = within.select("doc_id", F.coalesce("root", "rep").alias("group_id"))
    shared = named.groupBy("group_id").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("group_id", "least")
    return named.join(shared, "group_id").select("doc_id", F.col("least").alias("group_id"), (F.col("doc_id") == F.col("least")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, without the documents that groups() doesn't keep.

    Rows with a null doc_id or without a word stay, and so does every row of an id that is kept. An empty table
    gives an empty result.
    """
    gone = groups(docs).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))


def _sql() -> str:
    def word(w: int) -> str:
        source = "md5(t)" if w < 2 else "md5('+' || t)"
        return f"('0x' || substr({source}, {1 + 16 * (w % 2)}, 16))::UBIGINT AS h{w}"

    def bits(w: int) -> str:
        one = " + ".join(f"(CASE WHEN 2 * sum((h{w} >> {j}) & 1) > count(*) THEN {1 << j}::UBIGINT ELSE 0::UBIGINT END)" for j in range(64))
        return f"{one} AS f{w}"

    distance = " + ".join(f"bit_count(xor(a.f{w}, b.f{w}))::INTEGER" for w in range(WORDS))
    return rf"""
WITH RECURSIVE t AS (SELECT DISTINCT r, doc_id, unnest(regexp_extract_all(lower(text), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')) AS t
                     FROM (SELECT row_number() OVER () AS r, * FROM documents) WHERE doc_id IS NOT NULL),
h AS (SELECT r, doc_id, {", ".join(map(word, range(WORDS)))} FROM t),
p AS (SELECT r, doc_id, {", ".join(map(bits, range(WORDS)))} FROM h GROUP BY r, doc_id),
e AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM p a, p b WHERE a.doc_id <> b.doc_id AND {distance} <= {RADIUS}),
c AS (SELECT x AS node, x AS root FROM e UNION SELECT c.node, e.y FROM c JOIN e ON c.root = e.x),
g AS (SELECT node, min(root) AS root FROM c GROUP BY node)
SELECT p.doc_id, g.root AS group_id, p.doc_id = g.root AS kept FROM p JOIN g ON p.doc_id = g.node
"""


SQL = _sql()

"""Helpers shared by the operators: tables, shared storage, packed exchanges, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from sigspark.plans.storage import drop, materialize, numbered  # noqa: F401

BLOB_SCHEMA = "part int, blob binary"
#: Bytes of packed records that a task holds before it hands them on.
FLUSH_BYTES = 12 << 20
#: Bytes of input files whose records a task holds at once.
PART_BYTES = 16 << 20
#: Bytes of text that numpy works on at once.
SLICE_BYTES = 1 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB at most: a Python worker holds several, and rows may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(*frames: DataFrame) -> int:
    """Size of the files that these read, as the planner knows it; 0 for what it doesn't know."""
    total = 0
    for df in frames:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
        total += sum(x for x in sizes if x < 1 << 60)
    return total


def parts_of(*frames: DataFrame) -> int:
    """Parts for records made of these: one a partition, more where a part would get beyond what a task should hold."""
    return max(partitions(frames[0].sparkSession), -(-input_bytes(*frames) // PART_BYTES))


def free_name(names: list[str], wanted: str) -> str:
    """`wanted`, longer by underscores till it differs from all names; as in Spark, case doesn't count."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def with_numbers(docs: DataFrame, column: str, run: Callable[[DataFrame], DataFrame], *more: str) -> DataFrame:
    """run(docs), of which `column` and `more` hold ids; where ids are no integers, run sees their numbers in ascending order instead.

    docs has `column` and what else run needs; rows whose id is null are left out.
    """
    docs = docs.where(F.col(column).isNotNull())
    kind = docs.schema[column].dataType
    if isinstance(kind, IntegralType):
        return run(docs.withColumn(column, F.col(column).cast("bigint")))
    names = materialize(numbered(docs.select(F.col(column).alias("name_")).distinct(), ["name_"], "number_"))
    out = run(docs.join(names, docs[column] == names["name_"]).withColumn(column, F.col("number_")).drop("name_", "number_"))
    shown = out.columns
    for c in (column, *more):
        out = out.withColumnRenamed(c, "id_").join(names, F.col("id_") == names["number_"]).withColumnRenamed("name_", c).drop("id_", "number_")
    return out.select(*shown)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; returns a new array."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Roller:
    """Polynomial hashes, modulo 2**64, of ranges of an array of uint64 values.

    The value of a range depends on its content alone, not on where it lies.
    """

    def __init__(self, base: int):
        assert base % 2
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.zeros(0, np.uint64)

    def load(self, values: np.ndarray) -> None:
        n = len(values)
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = powers(self.base, size), powers(self.inverse, size + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self.up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def text_slices(column: pa.Array, limit: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, UTF-8 bytes, offsets) over runs of at most `rows` rows of about `limit` bytes. A null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, n, at + rows)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_spans(x: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the runs of bytes other than 0; a text's edge parts them too."""
    on = np.zeros(len(x) + 2, bool)
    on[1:-1] = x > 0
    first = on[1:] & ~on[:-1]
    ends = on[:-1] & ~on[1:]
    inner = offsets[(offsets > 0) & (offsets < len(x))]
    joined = inner[on[inner] & on[inner + 1]]
    first[joined] = True
    ends[joined] = True
    start = np.flatnonzero(first[: len(x)])
    return start, np.flatnonzero(ends), np.searchsorted(offsets, start, "right") - 1


class Packer:
    """Collects numpy records and hands them on as (part, blob) rows, by a 64-bit key.

    A blob holds its records field by field: what repeats from one record to the next compresses.
    """

    def __init__(self, parts: int, first: int = 0):
        """Parts are numbered from `first`."""
        self.parts, self.first, self.held, self.size = parts, first, [], 0

    def add(self, key: np.ndarray, records: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(records):
            self.held.append(((key % np.uint64(self.parts)).astype(np.int32) + np.int32(self.first), records))
            self.size += records.nbytes
        if self.size >= FLUSH_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            part = np.concatenate([p for p, _ in self.held])
            records = np.concatenate([r for _, r in self.held])
            self.held, self.size = [], 0
            order = np.argsort(part, kind="stable")
            part, records = part[order], records[order]
            fields = [np.ascontiguousarray(records[f]) for f in records.dtype.names]
            cuts = np.flatnonzero(np.diff(part)) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(part)]
            blobs = [b"".join([f[a:b].tobytes() for f in fields]) for a, b in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(part[starts]), pa.array(blobs, pa.binary())], ["part", "blob"])


def exchange(df: DataFrame, parts: int) -> DataFrame:
    """Bring the blobs of each of so many parts together; where a partition holds several, one after the other."""
    n = min(parts, partitions(df.sparkSession))
    met = df.repartitionById(n, (F.col("part") % n).cast("int"))
    return (met.sortWithinPartitions("part") if parts > n else met).select("part", "blob")


def unpack(blobs: list[bytes], dtype: np.dtype) -> np.ndarray:
    out, at = np.zeros(sum(map(len, blobs)) // dtype.itemsize, dtype), 0
    for blob in blobs:
        n, byte = len(blob) // dtype.itemsize, 0
        for f in dtype.names:
            kind = dtype[f]
            out[f][at : at + n] = np.frombuffer(blob, kind.base, n * (kind.itemsize // kind.base.itemsize), byte).reshape(n, *kind.shape)
            byte += n * kind.itemsize
        at += n
    return out


def blobs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Number and blobs of each part, after exchange()."""
    now, held = None, []
    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if part != now and held:
                whole, held = held, []
                yield now, whole
            now = part
            held.append(blob)
    if held:
        yield now, held


def unpacked(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> Iterator[np.ndarray]:
    """The records of each part, after exchange()."""
    for _, blobs in blobs_of(batches):
        yield unpack(blobs, dtype)


def runs(*sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal keys."""
    n = len(sorted_keys[0])
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(new)
    return starts, np.r_[starts[1:], n]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Distributed union-find by alternating large-star and small-star rounds.

    edges: pairs of BIGINT node ids. Returns (node, root), root the smallest id of the
    component, for every node of an edge. Every round is a table in the shared folder.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    pairs = materialize(pairs)
    mark = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while True:
        # large-star: every larger neighbour of u is tied to the least of u and its neighbours
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: u and its smaller neighbours are tied to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        pairs = materialize(small)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def within_bytes(rows: DataFrame, order: list[str], most: int, *by: str) -> DataFrame:
    """Of rows that are few, those up to which `text` adds up to `most` bytes in this order, for each value of `by`."""
    total = F.sum(F.octet_length("text").cast("bigint")).over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("bytes_", total).where(F.col("bytes_") <= most).drop("bytes_")

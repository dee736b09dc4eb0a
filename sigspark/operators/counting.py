"""Counts of terms, per document and over all of them, without a row for each term.

Sequences travel once, to the task that counts all of their document; what is counted over all documents travels as
stretches of text whose windows have one minimizer (the least hash of their 8-byte pieces), so that equal windows meet
in one bucket and 12 windows share about 42 bytes. Windows are compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.functions import kernels
from sigspark.plans.storage import bound_batches

#: Bytes of sequences from which stretches are made at once.
HELD = 1 << 24
#: Buckets for each partition of the shuffle; a bucket's windows are counted at once.
BUCKETS = 16
_PIECE = 8
#: Windows of one stretch at most.
_LONGEST = 64


def gathered(segments: DataFrame, key: str) -> DataFrame:
    """key, seq: all sequences of a key side by side in one partition."""
    bound_batches(segments.sparkSession)
    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return segments.where("seq is not null").select(key, "seq").repartition(parts, key).sortWithinPartitions(key)


def runs(batches: Iterator[pa.RecordBatch], width: int = 1) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(key columns, sequences) of each run of equal keys; the sequence is the last column."""
    now, held = None, []
    for batch in batches:
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(width))))
        seqs = batch.column(width)
        for i, key in enumerate(keys):
            if key != now:
                if held:
                    yield now, held
                now, held = key, []
            held.append(np.frombuffer(seqs[i].as_buffer(), np.uint8))
    if held:
        yield now, held


def joined(parts: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(padded bytes, places of the windows) of sequences; windows don't cross from one to the next."""
    buf = np.concatenate([*parts, np.zeros(kernels.PAD, np.uint8)])
    ends = np.cumsum([len(p) for p in parts])
    return buf, np.concatenate([np.arange(e - len(p), max(e - len(p), e - k + 1)) for p, e in zip(parts, ends)])


def distinct_counts(segments: DataFrame, key: str, k: int, canonicalize: bool = False) -> DataFrame:
    """key, terms, distinct_terms, and flipped and valid where terms are canonical, of every key with a term. Exact."""
    names = ["terms", "distinct_terms", *["flipped", "valid"] * canonicalize]
    kind = pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out))
            made = pa.RecordBatch.from_arrays([pa.array(columns[0], type_of[0]), *(pa.array(c, kind) for c in columns[1:])], [key, *names])
            out.clear()
            return made

        type_of: list = []

        def seen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                type_of[:] = [batch.schema.field(0).type]
                yield batch

        for (own,), parts in runs(seen()):
            if canonicalize:
                buf, places, flipped, valid = kernels.strands(parts, k)
                more = [int(flipped.sum()), int(valid.sum())]
            else:
                buf, places = joined(parts, k)
                more = []
            if len(places):
                out.append([own, len(places), len(kernels.first_places(buf, k, places)), *more])
            if len(out) >= 10_000:
                yield flush()
        if out:
            yield flush()

    field = segments.schema[key].dataType.simpleString()
    return gathered(segments, key).mapInArrow(run, f"`{key}` {field}, " + ", ".join(f"{n} bigint" for n in names))


def least_pieces(buf: np.ndarray, k: int) -> np.ndarray:
    """For the window at each byte of padded bytes the least hash of its pieces."""
    m = min(_PIECE, k)
    n = len(buf) - kernels.PAD - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    least = kernels.mixed(kernels.words_of(buf, m, slice(0, n + k - m)))
    reach, want = 1, k - m + 1
    while 2 * reach <= want:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < want:
        least = np.minimum(least[: len(least) - (want - reach)], least[want - reach :])
    return least


def stretches(buf: np.ndarray, k: int, wanted: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, place, length) of stretches that together have the wanted windows, each once; wanted: a mark for the window at each byte."""
    least = least_pieces(buf, k)
    n = len(least)
    if not n:  # all sequences are shorter than a window
        return (np.empty(0, np.int64),) * 3
    new = np.empty(n, bool)
    new[:1] = True
    np.not_equal(least[1:], least[:-1], out=new[1:])
    new[1:] |= ~wanted[: n - 1]
    at = np.flatnonzero(wanted[:n])
    fresh = new[at]
    begin = np.flatnonzero(fresh)
    size = np.diff(np.append(begin, len(at)))
    if (size > _LONGEST).any():
        cut = -(-size // _LONGEST)
        within = np.arange(cut.sum()) - np.repeat(np.cumsum(cut) - cut, cut)
        size = np.minimum(_LONGEST, np.repeat(size, cut) - within * _LONGEST)
        begin = np.repeat(begin, cut) + within * _LONGEST
    place = at[begin]
    return ((least[place] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets, place, size + k - 1


def taken(buf: np.ndarray, place: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches' bytes, one after the other."""
    ends = np.cumsum(length)
    return buf[np.arange(ends[-1] if len(ends) else 0) + np.repeat(place - (ends - length), length)]


def _blobs(buf: np.ndarray, bucket: np.ndarray, place: np.ndarray, length: np.ndarray) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """(bucket, which stretches, their lengths and bytes, compressed)."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for some in np.split(order, cuts) if len(order) else []:
        raw = length[some].astype("<u2").tobytes() + taken(buf, place[some], length[some]).tobytes()
        yield int(bucket[some[0]]), some, len(some).to_bytes(4, "little") + len(raw).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True)


def opened(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, bytes) of a blob's stretches."""
    n, size = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:8], "little")
    raw = np.frombuffer(pa.decompress(blob[8:], size, "zstd"), np.uint8)
    return raw[: 2 * n].view("<u2").astype(np.int64), raw[2 * n :]


def _places(length: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the windows, number of the stretch of each) of stretches that lie side by side."""
    n = length - k + 1
    begin = np.cumsum(length) - length
    which = np.repeat(np.arange(len(length)), n)
    return np.arange(len(which)) + (begin - (np.cumsum(n) - n))[which], which


def _first_marks(buf: np.ndarray, k: int, groups: list[np.ndarray]) -> np.ndarray:
    """Marks of one place of each different window of each group of places."""
    wanted = np.zeros(len(buf), bool)
    for places in groups:
        wanted[kernels.first_places(buf, k, places)] = True
    return wanted


def _collected(held: list[list[np.ndarray]], k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(padded bytes of all, places of the windows of each)."""
    buf = np.concatenate([*(p for parts in held for p in parts), np.zeros(kernels.PAD, np.uint8)])
    groups, at = [], 0
    for parts in held:
        own = []
        for p in parts:
            own.append(np.arange(at, at + max(0, len(p) - k + 1)))
            at += len(p)
        groups.append(np.concatenate(own))
    return buf, groups


def _bucketed(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket")


def document_frequencies(segments: DataFrame, key: str, k: int) -> DataFrame:
    """docs, terms: how many different terms occur in so many keys. Exact."""
    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = parts * BUCKETS

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(held: list[list[np.ndarray]]) -> pa.RecordBatch:
            buf, groups = _collected(held, k)
            found = list(_blobs(buf, *stretches(buf, k, _first_marks(buf, k, groups), buckets)))
            return pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in found], pa.int32()), pa.array([x for _, _, x in found], pa.binary())], ["bucket", "blob"])

        held, size = [], 0
        for _, own in runs(batches):
            held.append(own)
            size += sum(map(len, own))
            if size >= HELD:
                yield made(held)
                held, size = [], 0
        if held:
            yield made(held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = {}
        for _, blobs in runs(batches):
            pieces = [opened(b.tobytes()) for b in blobs]
            length = np.concatenate([n for n, _ in pieces])
            buf = np.concatenate([*(x for _, x in pieces), np.zeros(kernels.PAD, np.uint8)])
            del pieces
            places, _ = _places(length, k)
            for some in kernels.shares(buf, k, places):
                _, first = kernels.grouped(buf, k, places[some])
                at = np.append(np.flatnonzero(first), len(first))
                for docs, terms in zip(*np.unique(np.diff(at), return_counts=True)):
                    found[int(docs)] = found.get(int(docs), 0) + int(terms)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["docs", "terms"])

    moved = _bucketed(gathered(segments, key).mapInArrow(cut, "bucket int, blob binary"), parts)
    return moved.mapInArrow(count, "docs bigint, terms bigint").groupBy("docs").agg(F.sum("terms").cast("bigint").alias("terms"))


#: Bytes of sequences up to which they go to every task, beside the corpus; more of them meet it in a shuffle.
FEW = 1 << 19


def few(asked: DataFrame, own: list[str]) -> list | None:
    """The rows (own, seq) if they are few."""
    size = asked.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("seq"), F.lit(0)) + 16), F.lit(0))).first()[0]
    return asked.select(*own, "seq").collect() if size <= FEW else None


def lookup(seqs: list, k: int) -> tuple[kernels.Lookup, np.ndarray, np.ndarray]:
    """(their windows, and for each window of the sequences in turn its sequence and its number)."""
    buf, groups = _collected([[np.frombuffer(x, np.uint8)] for x in seqs], k)
    places = np.concatenate([np.empty(0, np.int64), *groups])
    found = kernels.Lookup(buf, k, places)
    at, number = found.find(buf, places)
    numbers = np.empty(len(places), np.int64)
    numbers[at] = number
    return found, np.repeat(np.arange(len(groups)), [len(g) for g in groups]), numbers


def _keys_of_few(rows: list, asked: DataFrame, segments: DataFrame, key: str, k: int) -> DataFrame:
    seqs = [bytes(r.seq) for r in rows if r.seq is not None]
    keys = [r[key] for r in rows if r.seq is not None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, owner, numbers = lookup(seqs, k)
        seen = np.zeros(len(known.h), bool)
        for batch in batches:
            column = batch.column(0)
            for i in range(len(column)):
                x = np.frombuffer(column[i].as_buffer(), np.uint8)
                for a in range(0, max(0, len(x) - k + 1), kernels.SHARE):
                    part = kernels.padded(x[a : a + kernels.SHARE + k - 1])
                    seen[known.find(part, slice(0, len(part) - kernels.PAD - k + 1))[1]] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(owner[seen[numbers]]), pa.int64())], ["_number"])

    spark = segments.sparkSession
    met = segments.where("seq is not null").select("seq").mapInArrow(run, "_number bigint").distinct()
    names = spark.createDataFrame(list(enumerate(keys)), f"_number bigint, `{key}` {asked.schema[key].dataType.simpleString()}")
    return names.join(met, "_number", "left_semi").select(key)


def keys_that_share(asked: DataFrame, segments: DataFrame, key: str, k: int) -> DataFrame:
    """The keys of asked (key, seq) that have a window which occurs in the segments (seq); a key may come several times. Exact, whatever the size of either."""
    spark = segments.sparkSession
    bound_batches(spark)
    if (rows := few(asked, [key])) is not None:
        return _keys_of_few(rows, asked, segments, key, k)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = parts * BUCKETS
    field = asked.schema[key].dataType.simpleString()
    schema = f"bucket int, asked boolean, blob binary, keys array<{field}>"

    def cut(named: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def made(seqs: list[np.ndarray], keys: list | None, kind) -> pa.RecordBatch:
                buf, groups = _collected([[x] for x in seqs], k)
                if named:
                    wanted = np.zeros(len(buf), bool)
                    for g in groups:
                        wanted[g] = True
                else:
                    wanted = _first_marks(buf, k, [np.concatenate(groups)])
                bucket, place, length = stretches(buf, k, wanted, buckets)
                found = list(_blobs(buf, bucket, place, length))
                owner = np.searchsorted(np.cumsum([len(x) for x in seqs]), place, "right")
                own = [[keys[i] for i in owner[some]] if named else None for _, some, _ in found]
                arrays = [pa.array([b for b, _, _ in found], pa.int32()), pa.array([named] * len(found), pa.bool_()), pa.array([x for _, _, x in found], pa.binary()), pa.array(own, pa.list_(kind))]
                return pa.RecordBatch.from_arrays(arrays, ["bucket", "asked", "blob", "keys"])

            seqs, keys, size, kind = [], [], 0, None
            for batch in batches:
                kind = batch.schema.field(0).type
                column = batch.column(1)
                for i, own in enumerate(batch.column(0).to_pylist()):
                    x = np.frombuffer(column[i].as_buffer(), np.uint8)
                    seqs.append(x)
                    keys.append(own)
                    size += len(x)
                    if size >= HELD:
                        yield made(seqs, keys, kind)
                        seqs, keys, size = [], [], 0
            if seqs:
                yield made(seqs, keys, kind)

        return run

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shared(rows: list) -> list:
            sides: dict[bool, list] = {True: [], False: []}
            for mark, blob, own in rows:
                sides[mark].append((*opened(blob), own))
            if not sides[True] or not sides[False]:
                return []
            every = sides[True] + sides[False]
            length = np.concatenate([n for n, _, _ in every])
            buf = np.concatenate([*(x for _, x, _ in every), np.zeros(kernels.PAD, np.uint8)])
            keys = [x for _, _, own in sides[True] for x in own]
            places, which = _places(length, k)
            bad = np.zeros(len(keys), bool)
            for some in kernels.shares(buf, k, places):
                order, first = kernels.grouped(buf, k, places[some])
                group = np.cumsum(first) - 1
                stretch = which[some][order]
                there = np.zeros(group[-1] + 1, bool) if len(group) else np.zeros(0, bool)
                there[group[stretch >= len(keys)]] = True
                mine = stretch < len(keys)
                bad[stretch[mine][there[group[mine]]]] = True
            return list(dict.fromkeys(keys[i] for i in np.flatnonzero(bad)))

        now, rows, kind = None, [], None
        for batch in batches:
            kind = batch.schema.field(3).type.value_type
            for bucket, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now:
                    if found := shared(rows):
                        yield pa.RecordBatch.from_arrays([pa.array(found, kind)], [key])
                    now, rows = bucket, []
                rows.append(row)
        if rows and (found := shared(rows)):
            yield pa.RecordBatch.from_arrays([pa.array(found, kind)], [key])

    mine = asked.where("seq is not null").select(key, "seq").mapInArrow(cut(True), schema)
    theirs = segments.where("seq is not null").select(F.lit(None).cast(field).alias(key), "seq").mapInArrow(cut(False), schema)
    return _bucketed(mine.unionByName(theirs), parts).mapInArrow(meet, f"`{key}` {field}")

"""Fuzzy line dedup by MinHash.

A line's shingles are its runs of `SHINGLE` characters, ASCII capitals made small. One-permutation
MinHash gives `BANDS` x `ROWS` bins; lines that agree in all bins of a band, after each empty bin has
borrowed from the next full one, are candidates. All members of a band's bucket are brought together
with their text and joined where the exact Jaccard similarity of their shingle sets is at least
`SIMILAR`; distributed union-find over these edges gives the components, and the first line of each by
(doc_id, line number) stays.

Equal lines are collapsed by a 64-bit hash before the bands (a polynomial modulo 2**64, for which unequal
lines of one hash can be made on purpose). At a similarity of 0.8 a pair is a candidate with probability
0.95, at 0.85 with 0.99; in a bucket nothing is lost, see joined(). A bucket of more than `HOT` lines is
cut into chunks by a hash of the line, and every two chunks meet in a task of their own. Within a bucket bit sketches
of the sets rule out pairs that can't be similar; what they leave is compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.llm.common import BLOB_SCHEMA, Packer, Roller, connected_components, exchange, free_name, materialize, mix, parts_of, runs, table, text_slices, unpacked, with_numbers

SHINGLE = 5
BANDS, ROWS = 10, 6
SIMILAR = 0.8
#: Lines of a bucket that one task looks at together, but for as many again.
HOT = 5000
#: Bits of the filter through which candidates pass on their way to their texts: 8 for each, within these bounds. Past the larger one more lines travel.
FILTER_BITS = (1 << 20, 1 << 26)
#: Lines that a task remembers to have sent.
REMEMBERED = 1 << 16
#: Shingles in sets that a task holds at once, but for two lines'.
KEPT = 1 << 18
#: Bytes of lines that are sketched at once, but for a bucket's.
SKETCHED = 1 << 18
#: Bytes of text that a task cuts into lines at once: what numpy makes of it stays near the CPU.
SLICE = 1 << 18

_BINS = BANDS * ROWS
_NONE = np.uint32(0xFFFFFFFF)
_rng = np.random.default_rng(20240611)
_WEIGHTS = (_rng.integers(0, 1 << 62, (BANDS, ROWS)) * 2 + 1).astype(np.uint64)
_SMALL = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_PLACES = (_rng.integers(0, 1 << 62, SHINGLE) * 2 + 1).astype(np.uint64)
MEMBER = np.dtype([("key", "<u8"), ("line", "<u8")])


def line_spans(x: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text and number in its text of every line that isn't blank."""
    breaks = np.flatnonzero(x == 10)
    start = np.sort(np.r_[offsets[:-1], breaks + 1], kind="stable")
    end = np.sort(np.r_[breaks, offsets[1:]], kind="stable")
    size = 1 + np.diff(np.searchsorted(breaks, offsets))
    text = np.repeat(np.arange(len(size)), size)
    number = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
    ink = np.zeros(len(x) + 1, np.int32)
    np.cumsum(x > 32, out=ink[1:])
    some = ink[end] > ink[start]
    return start[some], end[some], text[some], number[some]


def characters(x: np.ndarray) -> np.ndarray:
    """Code points of UTF-8."""
    return x if not len(x) or x.max() < 128 else np.frombuffer(x.tobytes().decode().encode("utf-32-le"), np.uint32)


def shingle_codes(points: np.ndarray) -> np.ndarray:
    """A number for the shingle that begins at each character; equal ones differ by chance only."""
    n = max(len(points) - SHINGLE + 1, 0)
    wide, out = points.astype(np.uint64), np.zeros(n, np.uint64)
    for i, weight in enumerate(_PLACES):
        out += wide[i : i + n] * weight
    return out


class Lines:
    """The lines of a slice of texts."""

    def __init__(self):
        self.roller = Roller(0x9E3779B97F4A7C15)

    def load(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.x = _SMALL[data]
        self.start, self.end, self.text, self.number = line_spans(self.x, offsets)
        self.roller.load(self.x.astype(np.uint64) + np.uint64(1))
        self.hash = self.roller.of(self.start, self.end)
        self.points = characters(self.x)
        self.first, self.last = self.start, self.end  # in characters
        if len(self.points) < len(self.x):
            before = np.r_[0, np.cumsum((self.x & 0xC0) != 0x80)]
            self.first, self.last = before[self.start], before[self.end]


def signatures(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(lines, bins) of minima; every line must have a shingle."""
    size = end - start - (SHINGLE - 1)
    line = np.repeat(np.arange(len(start), dtype=np.int64), size)
    at = np.arange(len(line)) + np.repeat(start - (np.cumsum(size) - size), size)
    h = shingle_codes(points)[at]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    where = (((h >> np.uint64(32)) * np.uint64(_BINS)) >> np.uint64(32)).astype(np.int64)
    where += line * _BINS
    out = np.full(len(start) * _BINS, _NONE, np.uint32)
    np.minimum.at(out, where, (h ^ (h >> np.uint64(37))).astype(np.uint32) & np.uint32(0xFFFFFFFE))
    return filled(out.reshape(-1, _BINS))


def filled(sig: np.ndarray) -> np.ndarray:
    """Empty bins take the next full one's value, changed by how far it is away."""
    rows = np.flatnonzero((sig == _NONE).any(1))
    for at in range(0, len(rows), 4096):
        mine = rows[at : at + 4096]
        s = sig[mine]
        column = np.where(s != _NONE, np.arange(_BINS, dtype=np.int16), np.int16(1000))
        twice = np.concatenate([column, column + np.int16(_BINS)], axis=1)
        ahead = np.minimum.accumulate(twice[:, ::-1], axis=1)[:, ::-1][:, :_BINS]
        far = (ahead - np.arange(_BINS, dtype=np.int16)).astype(np.uint32)
        sig[mine] = np.take_along_axis(s, (ahead % _BINS).astype(np.int64), 1) + far * np.uint32(0x9E3779B1)
    return sig


def band_keys(sig: np.ndarray) -> Iterator[np.ndarray]:
    for b in range(BANDS):
        yield mix((sig[:, b * ROWS : (b + 1) * ROWS].astype(np.uint64) * _WEIGHTS[b]).sum(1, dtype=np.uint64) + np.uint64(b))


def shingles(text: bytes) -> set[int]:
    return set(shingle_codes(characters(np.frombuffer(text, np.uint8))).tolist())


def sketches(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(lines, words): bits of which every shingle of a line sets one."""
    bits = min(1 << 13, max(1 << 8, 2 << int(sizes.max(initial=1)).bit_length()))
    out = np.zeros((len(sizes), bits >> 6), np.uint64)
    slot = ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - bits.bit_length())).astype(np.int64)
    step = max(1, (1 << 22) // bits)
    for at in range(0, len(sizes), step):
        n = sizes[at : at + step]
        on = np.zeros((len(n), bits), bool)
        line = np.repeat(np.arange(len(n)), n)
        on[line, slot[np.arange(len(line)) + np.repeat(starts[at : at + step] - (np.cumsum(n) - n), n)]] = True
        out[at : at + step] = np.packbits(on, axis=1).view(np.uint64)
    return out


def joined(sets: list[set[int]]) -> list[tuple[int, int]]:
    """Edges that join what all pairs of similarity SIMILAR or more join."""
    sizes = np.array([len(s) for s in sets], np.int64)
    codes = np.fromiter((x for s in sets for x in s), np.uint64, int(sizes.sum()))
    return joined_codes(codes, np.cumsum(sizes) - sizes, sizes, [0, len(sets)])


def joined_codes(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, cuts: list[int]) -> list[tuple[int, int]]:
    """Edges between lines of one bucket that join what all its pairs of similarity SIMILAR or more join.

    Line i has the shingles codes[starts[i] :][: sizes[i]], perhaps repeated; bucket k has the lines cuts[k] to
    cuts[k + 1]. Where two sketches differ in a bit, one line has a shingle that the other hasn't. A similar pair has
    at most a share of all its shingles that aren't common, so that more different bits rule a pair out; nothing else
    does. The others are compared set by set unless they are joined already.
    """
    marks = sketches(codes, starts, sizes)
    label = np.arange(len(sizes))
    sets: dict[int, set[int]] = {}
    kept = 0
    edges: list[tuple[int, int]] = []
    share = (1 - SIMILAR) / (1 + SIMILAR) + 1e-9

    def of(i: int) -> set[int]:
        nonlocal kept
        found = sets.get(i)
        if found is None:
            while sets and kept > KEPT:
                kept -= len(sets.pop(next(iter(sets))))
            found = sets[i] = set(codes[starts[i] : starts[i] + sizes[i]].tolist())
            kept += len(found)
        return found

    follows = np.bitwise_count(marks[:-1] ^ marks[1:]).sum(1, dtype=np.int32) <= share * (sizes[:-1] + sizes[1:])
    for a, b in zip(cuts[:-1], cuts[1:]):
        for j in range(a + 1, b):
            if j == a + 1:
                near = [a] if follows[a] else []
            else:
                apart = np.bitwise_count(marks[a:j] ^ marks[j]).sum(1, dtype=np.int32)
                near = np.flatnonzero(apart <= share * (sizes[a:j] + sizes[j]))
                near = (near[np.argsort(apart[near], kind="stable")] + a).tolist()
            for i in near:
                if label[i] == label[j]:
                    continue
                x, y = of(i), of(j)
                both = len(x & y)
                if both >= SIMILAR * (len(x) + len(y) - both) - 1e-9:
                    edges.append((i, j))
                    mine = label[a : j + 1]
                    mine[mine == label[j]] = label[i]
    return edges


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    return (mix(h) & np.uint64(bits - 1)).astype(np.int64)


def _filter(found: DataFrame, bits: int) -> np.ndarray:
    """Packed bits of the slots of these lines."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.zeros(bits >> 3, np.uint8)
        for batch in batches:
            slot = _slots(batch.column(0).to_numpy().view(np.uint64), bits)
            np.bitwise_or.at(packed, slot >> 3, (128 >> (slot & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(64, dtype=np.int32)), pa.array([p.tobytes() for p in packed.reshape(64, -1)], pa.binary())], ["n", "bits"])

    def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for n, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[n] = held.get(n, np.uint8(0)) | np.frombuffer(b, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([b.tobytes() for b in held.values()], pa.binary())], ["n", "bits"])

    marks = found.select("line").mapInArrow(mark, "n int, bits binary").repartition("n").mapInArrow(either, "n int, bits binary")
    seen = np.zeros((64, bits >> 9), np.uint8)
    for n, b in marks.collect():  # `bits` bits in all
        seen[n] = np.frombuffer(b, np.uint8)
    return seen.ravel()


def chunk_pairs(found: DataFrame, hot: int = HOT) -> DataFrame:
    """bucket, line, cell: rows of one bucket and cell meet. Buckets of at most `hot` lines have one cell; in others every two chunks have one."""
    sizes = found.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("bucket", F.ceil(F.col("n") / hot).cast("int").alias("chunks"))
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    mine = F.pmod(F.xxhash64("line"), F.col("chunks")).cast("int")
    cells = F.transform(every, lambda j: F.least(mine, j) * F.col("chunks") + F.greatest(mine, j))
    placed = found.join(sizes, "bucket", "left")
    return placed.select("bucket", "line", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(cells)).alias("cell"))


def _edges(rows: DataFrame, hot: int) -> DataFrame:
    """(a, b): hashes of lines that are similar."""
    spark = rows.sparkSession
    parts = parts_of(rows)

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, lines = Packer(parts), Lines()
        for batch in batches:
            for _, data, offsets in text_slices(batch.column(0), SLICE):
                lines.load(data, offsets)
                _, one = np.unique(lines.hash, return_index=True)
                one = np.sort(one[lines.last[one] - lines.first[one] >= SHINGLE])
                if not len(one):
                    continue
                for key in band_keys(signatures(lines.points, lines.first[one], lines.last[one])):
                    r = np.zeros(len(key), MEMBER)
                    r["key"], r["line"] = key, lines.hash[one]
                    yield from packer.add(key, r)
        yield from packer.flush()

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m in unpacked(batches, MEMBER):
            m = m[np.lexsort((m["line"], m["key"]))]
            if len(m):
                m = m[np.r_[True, m[1:] != m[:-1]]]
            starts, ends = runs(m["key"])
            many = ends - starts > 1
            starts, ends = starts[many], ends[many]
            if not len(starts):
                continue
            size = ends - starts
            at = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())
            line = m["line"][at]
            # a bucket is named by its members, so that the same set from several bands is looked at once
            name = mix(np.add.reduceat(mix(line ^ np.uint64(0xA5A5A5A5A5A5A5A5)), np.cumsum(size) - size) + size.astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, size).view(np.int64)), pa.array(np.ascontiguousarray(line).view(np.int64))], ["bucket", "line"])

    found = exchange(rows.select("text").mapInArrow(bands, BLOB_SCHEMA), parts).mapInArrow(buckets, "bucket bigint, line bigint")
    found = materialize(found.groupBy("bucket", "line").agg(F.lit(1).alias("one")).select("bucket", "line"))
    low, high = FILTER_BITS
    bits = min(high, max(low, 1 << (8 * found.count()).bit_length()))
    sent = spark.sparkContext.broadcast(_filter(found, bits))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, wanted, before = Lines(), sent.value, set()
        for batch in batches:
            for _, data, offsets in text_slices(batch.column(0), SLICE):
                lines.load(data, offsets)
                h, one = np.unique(lines.hash, return_index=True)
                slot = _slots(h, bits)
                hit = np.flatnonzero(((wanted[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1).astype(bool) & (lines.last[one] - lines.first[one] >= SHINGLE))
                hit = hit[[x not in before for x in h[hit].tolist()]]
                if len(before) > REMEMBERED:
                    before.clear()
                before.update(h[hit].tolist())
                whole = lines.x.tobytes()
                texts = [whole[a:b] for a, b in zip(lines.start[one[hit]].tolist(), lines.end[one[hit]].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(h[hit].view(np.int64)), pa.array(texts, pa.binary())], ["line", "content"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve() -> pa.RecordBatch:
            whole, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
            points = characters(whole)
            if len(points) < len(whole):
                ends = np.r_[0, np.cumsum((whole & 0xC0) != 0x80)][ends]
            e = joined_codes(shingle_codes(points), ends[:-1], np.diff(ends) - (SHINGLE - 1), [*cuts, len(names)])
            return pa.RecordBatch.from_arrays([pa.array([names[i] for i, _ in e], pa.int64()), pa.array([names[j] for _, j in e], pa.int64())], ["a", "b"])

        now, names, texts, cuts, size = None, [], [], [], 0
        for batch in batches:
            for bucket, cell, line, content in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (bucket, cell) != now:
                    if size > SKETCHED:
                        yield solve()
                        names, texts, cuts, size = [], [], [], 0
                    now = (bucket, cell)
                    cuts.append(len(names))
                names.append(line)
                texts.append(content)
                size += len(content)
        if names:
            yield solve()

    texts = rows.select("text").mapInArrow(fetch, "line bigint, content binary").dropDuplicates(["line"])
    met = chunk_pairs(found, hot).join(texts, "line").select("bucket", "cell", "line", "content")
    return met.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell").mapInArrow(verify, "a bigint, b bigint")


def duplicates(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, line, group_doc, group_line, kept: every line that is like another.

    Lines are parted by line feeds and numbered from 0; blank ones are never listed. Lines shorter
    than a shingle are like equal ones only. group_doc and group_line name the first line of the
    group by (doc_id, line), which is kept. Null texts and rows with a null doc_id have no lines. Rows
    that share a doc_id are one document: a place that occurs in several is listed for each, and is no copy of
    itself. Ids of any type that can be sorted will do. Other columns are ignored; an empty table gives an
    empty result.
    """
    return with_numbers(docs.where("text is not null").select("doc_id", "text"), "doc_id", lambda rows: _duplicates(rows, hot), "group_doc")


def _duplicates(rows: DataFrame, hot: int) -> DataFrame:
    roots = connected_components(_edges(rows, hot))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = Lines()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, data, offsets in text_slices(batch.column(1), SLICE):
                lines.load(data, offsets)
                yield pa.RecordBatch.from_arrays([pa.array(lines.hash.view(np.int64)), pa.array(ids[row + lines.text]), pa.array(lines.number)], ["hash", "doc_id", "line"])

    places = rows.mapInArrow(place, "hash bigint, doc_id bigint, line bigint")
    named = places.join(roots, places["hash"] == roots["node"], "left").select(F.coalesce("root", "hash").alias("g"), "doc_id", "line")
    first = named.groupBy("g").agg(F.min(F.struct("doc_id", "line")).alias("low"), F.max(F.struct("doc_id", "line")).alias("high")).where("low < high")
    return named.join(first, "g").select(
        "doc_id", "line", F.col("low.doc_id").alias("group_doc"), F.col("low.line").alias("group_line"), ((F.col("doc_id") == F.col("low.doc_id")) & (F.col("line") == F.col("low.line"))).alias("kept")
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """docs with all their columns, without the lines that duplicates() doesn't keep; n_chars follows the text.

    A row goes if it had a line that isn't blank and has none left. Rows without doc_id or text stay as they are.
    Repeated rows stay or go alike. An empty table gives an empty result.
    """
    names = docs.columns
    owner, lost = free_name(names, "gone_doc"), free_name(names, "gone_lines")
    gone = duplicates(docs).where("not kept").groupBy(F.col("doc_id").alias(owner)).agg(F.collect_set(F.col("line").cast("int")).alias(lost))
    both = docs.join(gone, docs["doc_id"] == gone[owner], "left")
    every = F.split("text", "\n", -1)
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.col(lost)), lambda i: F.get(every, i))
    text = F.when(F.col(lost).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    both = both.withColumn("text", text).where(F.col(lost).isNull() | F.col("text").rlike(r"[^\x00-\x20]"))
    if "n_chars" in names:
        n = F.when(F.col(lost).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
        both = both.withColumn("n_chars", n)
    return both.select(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "documents"))

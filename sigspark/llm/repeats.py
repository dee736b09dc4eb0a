"""Substring dedup with difference-cover anchors.

The words of a document are numbered. Windows of `WINDOW` words are hashed only where the number
modulo `PERIOD` is in `COVER`, a perfect difference set: every difference modulo PERIOD is that of
two of its members. Two equal passages of PERIOD + WINDOW - 1 = 50 words, wherever they lie, so
begin both at a common distance, below PERIOD, before a hashed window: they share an aligned anchor.

Anchors that occur twice are extended: the 50-word windows around them, and only those, are
hashed and brought together. What then occurs twice is every repeated window of 50 words, up to
collisions of 64-bit hashes (polynomials modulo 2**64, for which such texts can be made on
purpose), and neighbouring ones with the same source make up the maximal passages. All steps are
linear in the records; there are no pairs of documents, so thousands of copies cost no more each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.llm.common import BLOB_SCHEMA, FLUSH_BYTES, Packer, Roller, blobs_of, exchange, free_name, mix, numbered, parts_of, runs, table, text_slices, unpack, unpacked, with_numbers, word_spans

PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
WINDOW = 20
LENGTH = PERIOD + WINDOW - 1

_AT = np.isin(np.arange(PERIOD), COVER)
_BYTES, _WORDS = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
PLACE = np.dtype([("key", "<u8"), ("doc", "<i8"), ("at", "<i4")])
#: A place that stands for others (many) or for itself.
SEEN = np.dtype([("key", "<u8"), ("doc", "<i8"), ("at", "<i4"), ("many", "u1")])
#: A place and its representative; or, first, the source of all that this represents.
WAITING = np.dtype([("rep", "<u8"), ("doc", "<i8"), ("at", "<i4"), ("waits", "u1")])
MATCH = np.dtype([("doc", "<i8"), ("at", "<i4"), ("source", "<i8"), ("back", "<i4")])


def _fold() -> np.ndarray:
    """Digits, letters (capitals as small ones) and bytes of longer characters; 0 for the rest."""
    lut = np.zeros(256, np.uint8)
    for b in range(256):
        lut[b] = ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b > 127 else 0
    return lut


FOLD = _fold()


class Words:
    """Hashes of runs of words of the texts of a slice."""

    def __init__(self):
        self.bytes, self.words = Roller(_BYTES), Roller(_WORDS)

    def load(self, data: np.ndarray, offsets: np.ndarray) -> None:
        x = FOLD[data]
        start, end, self.text = word_spans(x, offsets)
        self.bytes.load(x.astype(np.uint64) + np.uint64(1))
        self.words.load(self.bytes.of(start, end))
        n = len(offsets) - 1
        self.count = np.bincount(self.text, minlength=n)
        self.first = np.cumsum(self.count) - self.count
        self.number = np.arange(len(start)) - self.first[self.text]

    def hashes(self, at: np.ndarray, size: int) -> np.ndarray:
        return self.words.of(at, at + size)


def _places(key: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(key), PLACE)
    out["key"], out["doc"], out["at"] = key, doc, at
    return out


def _shared(places: np.ndarray, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different places sorted by (key, doc, at), and starts and ends of the runs of a key that have at least so many."""
    places = places[np.lexsort((places["at"], places["doc"], places["key"]))]
    if len(places):
        new = np.r_[True, (places["key"][1:] != places["key"][:-1]) | (places["doc"][1:] != places["doc"][:-1]) | (places["at"][1:] != places["at"][:-1])]
        if "many" in places.dtype.names:
            places["many"] = np.repeat(np.maximum.reduceat(places["many"], np.flatnonzero(new)), np.diff(np.r_[np.flatnonzero(new), len(new)]))
        places = places[new]
    starts, ends = runs(places["key"])
    many = ends - starts >= least
    return places, starts[many], ends[many]


def _members(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    size = ends - starts
    return np.repeat(starts - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if len(size) else np.zeros(0, np.int64)


class Places:
    """Collects places by window, and hands on those that several tasks must compare and those that are represented."""

    def __init__(self):
        self.held, self.size = [], 0

    def add(self, places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        self.held.append(places)
        self.size += places.nbytes
        if self.size >= FLUSH_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(representatives, represented places, number of the representative of each)."""
        if self.held:
            places, starts, ends = _shared(np.concatenate(self.held), 1)
            self.held, self.size = [], 0
            seen = np.zeros(len(starts), SEEN)
            for f in ("key", "doc", "at"):
                seen[f] = places[f][starts]
            seen["many"] = ends - starts > 1
            yield seen, places[_members(starts + 1, ends)], np.repeat(np.arange(len(starts)), ends - starts - 1)


def _rep(seen: np.ndarray) -> np.ndarray:
    return mix(seen["key"] + mix(seen["doc"].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + seen["at"].astype(np.uint64)))


def _waiting(rep: np.ndarray, doc: np.ndarray, at: np.ndarray, waits: int) -> np.ndarray:
    out = np.zeros(len(rep), WAITING)
    out["rep"], out["doc"], out["at"], out["waits"] = rep, doc, at, waits
    return out


def _matches(places: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(places), MATCH)
    out["doc"], out["at"], out["source"], out["back"] = places["doc"], places["at"], doc, places["at"] - at
    return out[np.lexsort((out["at"], out["doc"]))]


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, start, n_words, source_id, source_start: passages of at least 50 words that occur earlier.

    Every 50-word window that occurs at several places belongs, at each place but the first by
    (doc_id, place), to one row; windows that follow each other and whose first places do so too
    form a row. start counts the document's words from 0. A word is a run of ASCII letters and digits
    and of all longer characters; ASCII case doesn't count. A source in the same document counts.

    Null texts, shorter ones and rows with a null doc_id have no passages. Rows that share a doc_id
    are one document: equal windows at the same place of both are one. Ids of any type that can be
    sorted will do; source_id has it too. Other columns are ignored; an empty table gives an empty result.
    """
    return with_numbers(docs.where("text is not null").select("doc_id", "text"), "doc_id", _repeats, "source_id")


def _repeats(rows: DataFrame) -> DataFrame:
    parts = parts_of(rows)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, alone, met, words = Places(), Packer(parts), Packer(parts, parts), Words()

        def hand(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for seen, others, of in found:
                yield from alone.add(seen["key"], seen)
                # what occurs twice here needs no other task to tell
                twice = np.concatenate([_places(seen["key"], seen["doc"], seen["at"])[seen["many"] > 0], others])
                yield from met.add(mix(twice["doc"].view(np.uint64)), twice)

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, data, offsets in text_slices(batch.column(1)):
                words.load(data, offsets)
                count = words.count[words.text]
                at = np.flatnonzero(_AT[words.number % PERIOD] & (words.number + WINDOW <= count) & (count >= LENGTH))
                yield from hand(places.add(_places(words.hashes(at, WINDOW), ids[row + words.text[at]], words.number[at])))
        yield from hand(places.flush())
        yield from alone.flush()
        yield from met.flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, blobs in blobs_of(batches):
            if part < parts:
                places, starts, ends = _shared(unpack(blobs, SEEN))
                hit = places[_members(starts, ends)]
            else:
                hit = unpack(blobs, PLACE)
            hit = hit[np.lexsort((hit["at"], hit["doc"]))]
            first, last = runs(hit["doc"])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(hit)].astype(np.int32) if len(first) else np.zeros(1, np.int32)), pa.array(np.ascontiguousarray(hit["at"])))
            yield pa.RecordBatch.from_arrays([pa.array(hit["doc"][first]), lists], ["doc", "ats"])

    met = exchange(rows.mapInArrow(anchors, BLOB_SCHEMA), 2 * parts).mapInArrow(meet, "doc bigint, ats array<int>")
    met = met.groupBy("doc").agg(F.flatten(F.collect_list("ats")).alias("ats"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, alone, waiting, words = Places(), Packer(parts), Packer(parts, parts), Words()

        def hand(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for seen, others, of in found:
                yield from alone.add(seen["key"], seen)
                rep = _rep(seen)[of]
                yield from waiting.add(rep, _waiting(rep, others["doc"], others["at"], 1))

        for batch in batches:
            ids = batch.column(0).to_numpy()
            lists = batch.column(2)
            edges, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            for row, data, offsets in text_slices(batch.column(1)):
                words.load(data, offsets)
                n = len(offsets) - 1
                at = values[edges[row] : edges[row + n]]
                text = np.repeat(np.arange(n), np.diff(edges[row : row + n + 1]))
                low = np.maximum(at - (PERIOD - 1), 0)
                high = np.minimum(at, words.count[text] - LENGTH) + 1
                some = high > low
                base = words.first[text[some]]
                wanted = np.zeros(len(words.text) + 1, np.int64)
                np.add.at(wanted, base + low[some], 1)
                np.add.at(wanted, base + high[some], -1)
                at = np.flatnonzero(np.cumsum(wanted)[:-1] > 0)
                yield from hand(places.add(_places(words.hashes(at, LENGTH), ids[row + words.text[at]], words.number[at])))
        yield from hand(places.flush())
        yield from alone.flush()
        yield from waiting.flush()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, matches = Packer(parts), Packer(parts, parts)
        for part, blobs in blobs_of(batches):
            if part >= parts:
                w = unpack(blobs, WAITING)
                yield from waiting.add(w["rep"], w)
                continue
            places, starts, ends = _shared(unpack(blobs, SEEN), 1)
            origin = np.repeat(starts, ends - starts)
            later = np.flatnonzero(origin != np.arange(len(places)))
            made = _matches(places[later], places["doc"][origin[later]], places["at"][origin[later]])
            for at in range(0, len(made), 1 << 20):
                yield from matches.add(mix(made["doc"][at : at + (1 << 20)].view(np.uint64)), made[at : at + (1 << 20)])
            many = np.flatnonzero(places["many"])
            rep = _rep(places[many])
            yield from waiting.add(rep, _waiting(rep, places["doc"][origin[many]], places["at"][origin[many]], 0))
        yield from waiting.flush()
        yield from matches.flush()

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = Packer(parts)
        for part, blobs in blobs_of(batches):
            if part >= parts:
                made = unpack(blobs, MATCH)
            else:
                w = unpack(blobs, WAITING)
                w = w[np.lexsort((w["waits"], w["rep"]))]
                starts, ends = runs(w["rep"])
                origin = np.repeat(starts, ends - starts)
                waits = w["waits"] > 0
                made = _matches(w[waits], w["doc"][origin[waits]], w["at"][origin[waits]])
            for at in range(0, len(made), 1 << 20):
                yield from matches.add(mix(made["doc"][at : at + (1 << 20)].view(np.uint64)), made[at : at + (1 << 20)])
        yield from matches.flush()

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m in unpacked(batches, MATCH):
            m = m[np.lexsort((m["at"], m["back"], m["source"], m["doc"]))]
            same = (m["doc"][1:] == m["doc"][:-1]) & (m["at"][1:] == m["at"][:-1])
            m = m[np.r_[True, ~same]] if len(m) else m  # a row that is there several times
            starts, ends = runs(m["doc"], m["source"], m["back"], m["at"] - np.arange(len(m)))
            head = m[starts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(head["doc"]), pa.array(head["at"].astype(np.int64)), pa.array((ends - starts) + (LENGTH - 1)), pa.array(head["source"]), pa.array((head["at"] - head["back"]).astype(np.int64))],
                ["doc_id", "start", "n_words", "source_id", "source_start"],
            )

    texts = rows.join(met, rows["doc_id"] == met["doc"]).select("doc_id", "text", "ats")
    windows = exchange(texts.mapInArrow(extend, BLOB_SCHEMA), 2 * parts).mapInArrow(first, BLOB_SCHEMA)
    found = exchange(windows, 2 * parts).mapInArrow(resolve, BLOB_SCHEMA)
    return exchange(found, parts).mapInArrow(passages, "doc_id bigint, start bigint, n_words bigint, source_id bigint, source_start bigint")


def drop_repeats(docs: DataFrame) -> DataFrame:
    """docs with all their columns, without the passages that repeats() finds; n_chars follows the text.

    Here every row is a document of its own, and the first place is that of the first row by (doc_id, text),
    null ids first. A passage goes from its first word to the next word after it. A row goes if it had a word and
    has none left; null texts and texts without a word stay as they are. An empty table gives an empty result.
    """
    number, ranges = free_name(docs.columns, "number"), free_name(docs.columns, "ranges")
    rows = numbered(docs, ["doc_id", "text"], number)
    found = _repeats(rows.where("text is not null").select(F.col(number).alias("doc_id"), "text"))
    gone = found.groupBy("doc_id").agg(F.collect_list(F.array("start", "n_words")).alias(ranges)).withColumnRenamed("doc_id", number)
    names, text = docs.columns, docs.columns.index("text")
    n_chars = names.index("n_chars") if "n_chars" in names else -1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = batch.column(text).to_pylist(), []
            for i, holes in enumerate(batch.column(len(names)).to_pylist()):
                if holes and texts[i] is not None:
                    texts[i] = without(texts[i].encode(), holes)
                keep.append(not holes or texts[i] is not None)
            columns = batch.columns[: len(names)]
            columns[text] = pa.array(texts, batch.schema.field(text).type)
            if n_chars >= 0:
                sizes = [old if not holes else len(t or "") for old, holes, t in zip(columns[n_chars].to_pylist(), batch.column(len(names)).to_pylist(), texts)]
                columns[n_chars] = pa.array(sizes, columns[n_chars].type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep, pa.bool_()))

    return rows.join(gone, number, "left").select(*docs.columns, ranges).mapInArrow(cut, docs.schema)


def without(text: bytes, holes: list[list[int]]) -> str | None:
    """A text without the words of these ranges (start, number); None if no word is left."""
    x = FOLD[np.frombuffer(text, np.uint8)]
    start, _, _ = word_spans(x, np.array([0, len(x)]))
    gone = np.zeros(len(start) + 1, np.int64)
    for at, n in holes:
        gone[at] += 1
        gone[at + n] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    if gone.all():
        return None
    edges = np.r_[start, len(x)]
    first = np.flatnonzero(gone & ~np.r_[False, gone[:-1]])
    last = np.flatnonzero(gone & ~np.r_[gone[1:], False])
    kept, at = [], 0
    for a, b in zip(edges[first].tolist(), edges[last + 1].tolist()):
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]]).decode()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w
           FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
p AS (SELECT DISTINCT doc_id, i - 1 AS pos, md5(array_to_string(w[i:i + {LENGTH - 1}], ' ')) AS s
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - {LENGTH} + 2)) AS i FROM d WHERE len(w) >= {LENGTH})),
f AS (SELECT doc_id, pos, first_value(doc_id) OVER o AS source_id, first_value(pos) OVER o AS source_at FROM p WINDOW o AS (PARTITION BY s ORDER BY doc_id, pos)),
m AS (SELECT *, pos - source_at AS back, pos - row_number() OVER (PARTITION BY doc_id, source_id, pos - source_at ORDER BY pos) AS island
      FROM f WHERE doc_id <> source_id OR pos <> source_at)
SELECT doc_id, min(pos) AS start, count(*) + {LENGTH - 1} AS n_words, source_id, min(pos) - back AS source_start
FROM m GROUP BY doc_id, source_id, back, island
"""

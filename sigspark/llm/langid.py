"""Language identification by nearest centroid.

Byte trigrams of the lower-cased text are hashed to buckets; vectors are normalised TF-IDF,
document frequencies counted over all documents. Each language has several centroids from
spherical k-means over a bounded sample of labelled rows (`per_language`, `most_bytes`). A document takes
the language of the centroid with the highest cosine and is rejected if that is below the
language's limit for texts with as many different trigrams, see floors().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigspark.llm.common import free_name, table, text_slices, within_bytes

BITS = 12
DIM = 1 << BITS
#: Limits are by powers of 2 of the number of different trigrams; the last holds all longer texts.
BANDS = 10
#: Texts whose counts are held at once.
ROWS = 512


def _letters() -> np.ndarray:
    """ASCII letters and bytes of longer characters stay, everything else is a space."""
    lut = np.full(256, 32, np.uint8)
    for b in [*range(97, 123), *range(128, 256)]:
        lut[b] = b
    for b in range(65, 91):
        lut[b] = b + 32
    return lut


LETTERS = _letters()


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Trigram counts, one row of DIM for each text."""
    n = len(offsets) - 1
    if len(data) < 3:
        return np.zeros((n, DIM), np.int64)
    x = LETTERS[data].astype(np.uint32)
    code = x[:-2] | (x[1:-1] << np.uint32(8)) | (x[2:] << np.uint32(16))
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.int64)
    size = np.diff(offsets)
    at = np.repeat(np.arange(n), size)[: len(bucket)]
    inside = np.ones(len(bucket), bool)
    for back in (1, 2):  # windows that start in the last two bytes of a text reach into the next
        cut = offsets[1:] - back
        inside[cut[(cut >= 0) & (cut < len(bucket))]] = False
    blank = code == 0x202020
    inside &= ~blank
    return np.bincount(at[inside] * DIM + bucket[inside], minlength=n * DIM).reshape(n, DIM)


def vectors(data: np.ndarray, offsets: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts(data, offsets).astype(np.float32)) * idf
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.where(norm > 0, norm, 1)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    floor: np.ndarray

    def label(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language numbers (-1: no trigram), cosines and rejections."""
        v = vectors(data, offsets, self.idf)
        if not self.languages:
            return np.full(len(v), -1), np.zeros(len(v)), np.ones(len(v), bool)
        cos = v @ self.centroids.T
        best = cos.argmax(1)
        top = cos[np.arange(len(v)), best].astype(np.float64)
        none = ~v.any(1)
        return np.where(none, -1, self.owner[best]), np.where(none, 0.0, top), none | (top < self.floor[best, bands(v)])


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Centroids (of those that own a row) and each row's centroid. Starts with rows at even steps."""
    c = x[np.unique(np.linspace(0, len(x) - 1, k).astype(int))]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = np.stack([x[own == j].sum(0) for j in np.unique(own)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c, (x @ c.T).argmax(1)


def bands(v: np.ndarray) -> np.ndarray:
    """Number of the limit that holds for each vector."""
    return np.minimum(np.log2(np.maximum(np.count_nonzero(v, axis=1), 1)).astype(np.int64), BANDS - 1)


def pieces(texts: list[bytes], idf: np.ndarray, shuffled: bool = False) -> np.ndarray:
    """Vectors of pieces of every length, one of each from each text, that start with a word; shuffled: of their letters in random order."""
    rng, out = np.random.default_rng(20240613), []
    for text in texts:
        x = np.frombuffer(text, np.uint8)
        starts = np.flatnonzero(np.r_[True, LETTERS[x[:-1]] == 32] & (LETTERS[x] != 32))
        for k in range(2, BANDS + 1):
            left = starts[starts + (1 << k) <= len(x)]
            if len(left):
                at = left[rng.integers(len(left))]
                piece = x[at : at + (1 << k) + (1 << (k - 1))]
                out.append(rng.permutation(piece) if shuffled else piece)
    v = [vectors(d, o, idf) for _, d, o in text_slices(pa.array([p.tobytes() for p in out], pa.binary()), rows=ROWS)]
    v = np.concatenate(v) if v else np.zeros((0, DIM), np.float32)
    return v[v.any(1)]


def floors(own: tuple[np.ndarray, np.ndarray], foreign: tuple[np.ndarray, np.ndarray], tail: float) -> np.ndarray:
    """A limit for each band, from (bands, highest cosines) of pieces.

    Between what all but `tail` of the foreign pieces stay below and what all but `tail` of the language's own
    reach, it is a quarter of the way up. Where texts are too short to tell them apart, it is what all but `tail` of the
    language's own reach, but never less than half of the foreign ones do. A band
    without pieces has the limit of the nearest shorter one, or else of the shortest that has some. From
    four trigrams on, limits never fall with length.
    """
    out = np.full(BANDS, np.nan)
    for b in range(BANDS):
        mine, other = own[1][own[0] == b], foreign[1][foreign[0] == b]
        if len(mine) and len(other):
            low, high = np.quantile(other, 1 - tail), np.quantile(mine, tail)
            out[b] = low + (high - low) / 4 if high > low else max(np.quantile(other, 0.5), high)
    have = np.flatnonzero(~np.isnan(out))
    if not len(have):
        return np.zeros(BANDS)
    out = out[have[np.maximum(np.searchsorted(have, np.arange(BANDS), "right") - 1, 0)]]
    out[2:] = np.maximum.accumulate(out[2:])
    return out


def train(docs: DataFrame, per_language: int = 400, clusters: int = 4, tail: float = 0.01, languages: int = 200, most_bytes: int = 16 << 20) -> Model:
    """docs: doc_id, text, lang. Rows without text or lang teach nothing; with none at all, everything is rejected.

    The sample has at most `per_language` rows and `most_bytes` bytes of each of the `languages` most frequent
    languages, in the order of a hash of id and text; of equal rows it has one.
    """
    spark = docs.sparkSession
    lowered = docs.select(F.lower("text").alias("text"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for _, data, offsets in text_slices(batch.column(0), rows=ROWS):
                df += (counts(data, offsets) > 0).sum(0)
                n += len(offsets) - 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIM, dtype=np.int32)), pa.array(np.r_[n, df])], ["bucket", "df"])

    found = {r.bucket: r.df for r in lowered.mapInArrow(frequencies, "bucket int, df bigint").groupBy("bucket").agg(F.sum("df").alias("df")).collect()}
    df = np.array([found.get(i, 0) for i in range(DIM)])
    idf = (np.log((1 + found.get(-1, 0)) / (1 + df)) + 1).astype(np.float32)

    labelled = docs.where("lang is not null and text is not null and length(text) > 0").select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    common = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).select("lang")
    ranked = labelled.select("lang", "h", F.row_number().over(Window.partitionBy("lang").orderBy("h")).alias("n"))
    limits = ranked.where(F.col("n") <= per_language).groupBy("lang").agg(F.max("h").alias("most")).join(common, "lang")
    rows = labelled.join(F.broadcast(limits), "lang").where(F.col("h") <= F.col("most")).groupBy("lang", "h").agg(F.min("text").alias("text"))
    rows = within_bytes(rows, ["h"], most_bytes, "lang").select("lang", F.lower("text").alias("text"), "h").orderBy("lang", "h").toArrow()
    langs = np.array(rows.column("lang").to_pylist(), object)
    x = [vectors(d, o, idf) for _, d, o in text_slices(rows.column("text"), rows=ROWS)]
    x = np.concatenate(x) if x else np.zeros((0, DIM), np.float32)
    names = sorted({lang for lang, v in zip(langs, x) if v.any()})
    texts = [t.encode() for t in rows.column("text").to_pylist()]
    centroids, owner, floor, halves, cut = [], [], [], [], {}
    for i, name in enumerate(names):
        at = np.flatnonzero((langs == name) & x.any(1))
        c, own = spherical_kmeans(x[at], clusters)
        for j in np.unique(own):
            centroids.append(c[j])
            owner.append(i)
        # limits come from pieces of rows that the centroids they are held against haven't seen
        halves.append(spherical_kmeans(x[at[::2]], clusters)[0])
        for shuffled in (False, True):
            cut[i, shuffled] = pieces([texts[k] for k in (at[1::2] if len(at) > 1 else at)], idf, shuffled)
    for i in range(len(names)):
        met = {key: (bands(v), (v @ halves[i].T).max(1)) for key, v in cut.items()}
        foreign = [m for (k, shuffled), m in met.items() if k != i or shuffled]
        floor.append(floors(met[i, False], (np.concatenate([b for b, _ in foreign]), np.concatenate([m for _, m in foreign])), tail))
    owner = np.array(owner, np.int64)
    return Model(names, idf, np.stack(centroids) if centroids else np.zeros((0, DIM), np.float32), owner, np.array(floor, np.float64).reshape(-1, BANDS)[owner])


def _each(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = [model.label(d, o) for _, d, o in text_slices(column, rows=ROWS)]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Every row's doc_id, lang as given, pred_lang, cosine and rejected.

    Null, empty and trigram-free texts get a null pred_lang, cosine 0 and are rejected. Ties go
    to the language first by name. Repeated rows stay, null doc_ids too; other columns are ignored.
    """
    model = model or train(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            which, cos, rejected = _each(m, batch.column(2))
            names = pa.array([m.languages[i] if i >= 0 else None for i in which], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), names, pa.array(cos), pa.array(rejected)], ["doc_id", "lang", "pred_lang", "cosine", "rejected"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, pred_lang string, cosine double, rejected boolean"
    return docs.select("doc_id", "lang", F.lower("text").alias("text")).mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of docs, with all their columns, that identify() does not reject.

    Null, empty and trigram-free texts go; repeated rows stay or go alike. An empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model or train(docs))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rejected = _each(sent.value, batch.column(len(names)))[2]
            yield batch.filter(pa.array(~rejected)).select(list(range(len(names))))

    return docs.withColumn(free_name(names, "lowered"), F.lower("text")).mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))

"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words, trained in numpy from confirmed toxic documents and a
sample of all documents taken as unlabelled. Its risk is prior * R+(positives) plus
max(0, R-(unlabelled) - prior * R-(positives)); where that second part would fall below
`-beta` the step goes the other way, so that positives hidden in the sample are not learned
as negatives. Both samples are bounded (`positives`, `unlabelled`, `most_bytes`); scoring covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.llm.common import Roller, mix, runs, table, text_slices, within_bytes, word_spans

BITS = 18
DIM = 1 << BITS


def _word_bytes() -> np.ndarray:
    lut = np.zeros(256, np.uint8)
    for b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
        lut[b] = b
    return lut


WORD = _word_bytes()


def word_bags(data: np.ndarray, offsets: np.ndarray, roller: Roller) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of the distinct words of each text, sorted."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = WORD[data]
    start, end, text = word_spans(x, offsets)
    roller.load(x.astype(np.uint64) + np.uint64(1))
    bucket = (roller.of(start, end) >> np.uint64(64 - BITS)).astype(np.int64)
    found = np.unique(text * DIM + bucket)
    return found >> BITS, found & (DIM - 1)


def _totals(text: np.ndarray, n: int, values: np.ndarray) -> np.ndarray:
    return np.bincount(text, values, minlength=n)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray, roller: Roller) -> np.ndarray:
        n = len(offsets) - 1
        text, bucket = word_bags(data, offsets, roller)
        return 1 / (1 + np.exp(-np.clip(_totals(text, n, self.weights[bucket]) + self.bias, -30, 30)))


def lift(positive: np.ndarray, text: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """z-score, for each bucket, of its share of positive against its share of unlabelled texts."""
    n, m = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    a = np.bincount(bucket[positive[text]], minlength=DIM) + 0.5
    b = np.bincount(bucket[~positive[text]], minlength=DIM) + 0.5
    p = (a + b) / (n + m + 2)
    return (a / (n + 1) - b / (m + 1)) / np.sqrt(p * (1 - p) * (1 / n + 1 / m))


def first_of_copies(text: np.ndarray, bucket: np.ndarray, n: int, share: float = 0.05, bands: int = 4, rows: int = 4) -> np.ndarray:
    """Whether each of n texts is no near-copy of an earlier one, as MinHash bands over words of few texts tell."""
    keep, df = np.ones(n, bool), np.bincount(bucket, minlength=DIM)
    rare = df[bucket] <= max(2, share * n)
    text, bucket = text[rare], bucket[rare]
    starts, ends = runs(text)
    if not len(starts):
        return keep
    for b in range(bands):
        key = np.zeros(len(starts), np.uint64)
        for r in range(rows):
            h = mix(bucket.astype(np.uint64) + np.uint64((b * rows + r + 1) << 32))
            key = mix(key * np.uint64(31) + np.minimum.reduceat(h, starts))
        _, first = np.unique(key, return_index=True)
        copy = np.ones(len(starts), bool)
        copy[first] = False
        keep[text[starts[copy]]] = False
    return keep


def fit(texts: pa.Array, positive: np.ndarray, prior: float, least_z: float = 5.0, epochs: int = 300, rate: float = 0.05, decay: float = 1e-5, beta: float = 0.0) -> Model:
    """positive: True for confirmed toxic rows; the others count as unlabelled.

    Words whose lift() is within `least_z` of 0 get no weight. Of near-copies on the same side one
    counts, so that what a much-copied document happens to say isn't taken for a sign.
    """
    roller, parts, n = Roller(0x9E3779B97F4A7C15), [], 0
    for at, data, offsets in text_slices(texts):
        t, b = word_bags(data, offsets, roller)
        parts.append((t + at, b))
        n = at + len(offsets) - 1
    w, bias = np.zeros(DIM), 0.0
    if parts:
        text, bucket = (np.concatenate(x) for x in zip(*parts))
        keep = np.ones(n, bool)
        for side in (positive, ~positive):
            mine = side[text]
            keep &= first_of_copies(text[mine], bucket[mine], n)
        stays = keep[text]
        text, bucket = (np.cumsum(keep) - 1)[text[stays]], bucket[stays]
        positive, n = positive[keep], int(keep.sum())
    npos, nunl = int(positive.sum()), int((~positive).sum())
    if not npos or not nunl:
        return Model(w, -1.0)  # calls nothing toxic
    used = (np.abs(lift(positive, text, bucket)) > least_z)[bucket]
    names, bucket = np.unique(bucket[used], return_inverse=True)
    text, k = text[used], len(names)
    u, m, v, mb, vb = np.zeros(k), np.zeros(k), np.zeros(k), 0.0, 0.0
    for step in range(1, epochs + 1):
        z = np.clip(_totals(text, n, u[bucket]) + bias, -30, 30)
        s = 1 / (1 + np.exp(-z))  # logistic loss: slopes are s as a negative, s - 1 as a positive
        loss = np.logaddexp(0, z)
        negative = loss[~positive].mean() - prior * loss[positive].mean()
        down = np.where(positive, -prior / npos, 1 / nunl) * s
        grad = -down if negative < -beta else down + np.where(positive, prior / npos, 0.0) * (s - 1)
        gu, gb = np.bincount(bucket, grad[text], minlength=k) + decay * u, grad.sum()
        m, v = 0.9 * m + 0.1 * gu, 0.999 * v + 0.001 * gu * gu
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, c = 1 - 0.9**step, 1 - 0.999**step
        u = u - rate * (m / a) / (np.sqrt(v / c) + 1e-8)
        bias = bias - rate * (mb / a) / (np.sqrt(vb / c) + 1e-8)
    w[names] = u
    return Model(w, min(bias, -1e-6))


def train(docs: DataFrame, labels: DataFrame, positives: int = 2000, unlabelled: int = 8000, prior: float | None = None, most_bytes: int = 64 << 20) -> Model:
    """prior: share of toxic documents; by default that among the labelled ones. No positives: a model that calls nothing toxic.

    Both samples are ids in the order of a hash; an id with several texts teaches the first by sorting, and each
    sample ends where it has `most_bytes` bytes of text. Rows without id, text or label teach nothing.
    """
    spark = docs.sparkSession
    known = labels.where("toxic is not null and doc_id is not null").select("doc_id", "toxic")
    n, share = known.agg(F.count("*"), F.avg((F.col("toxic") > 0).cast("double"))).first()
    prior = prior if prior is not None else (share or 0.0)
    chosen = known.where("toxic > 0").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives).withColumn("positive", F.lit(True))
    sample = docs.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(unlabelled).withColumn("positive", F.lit(False))
    rows = spark.createDataFrame(chosen.unionByName(sample).toArrow())  # bounded by the two limits
    got = docs.where("text is not null").join(F.broadcast(rows), "doc_id").groupBy("doc_id", "positive").agg(F.min("text").alias("text"))
    got = within_bytes(got.withColumn("h", F.xxhash64("doc_id")), ["h", "doc_id"], most_bytes, "positive").select("positive", "doc_id", F.lower("text").alias("text")).orderBy("positive", "doc_id").toArrow()
    return fit(got.column("text"), np.array(got.column("positive").to_pylist(), bool), prior)


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """Every row's doc_id, score and toxic (score above one half).

    A null text or one without words scores by the bias alone and is not toxic. Repeated rows and
    null doc_ids stay; other columns are ignored; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller(0x9E3779B97F4A7C15)
        for batch in batches:
            found = [sent.value.score(d, o, roller) for _, d, o in text_slices(batch.column(1))]
            score = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(score > 0.5)], ["doc_id", "score", "toxic"])

    return docs.select("doc_id", F.lower("text").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, toxic boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels")))

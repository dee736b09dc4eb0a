"""URL filter: host words by unigram Viterbi, scored by multinomial naive Bayes.

Word counts come from all documents. Every label of a host (what lies between its dots and dashes) is
split into the words of the highest product of unigram probabilities: its substrings are joined to
the counts, so that no vocabulary is gathered or broadcast, and a dynamic programme runs over what was
found. The words of the host and the tokens of the path are the features of a multinomial naive
Bayes classifier whose counts cover every labelled page.

The tables have no labels for pages. A page takes the `quality` of the document that its path names
with its last number; quality 0 is the class to be blocked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.llm.common import Roller, materialize, table, text_slices, word_spans

#: Letters that a label of a host has at most.
LABEL = 63
ALPHA = 1.0
NUMBER = "#"
#: Words that a task holds before it hands them on.
HELD = 500_000

_LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 0 for b in range(256)], np.uint8)


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: how often each word, a run of letters a to z and of all longer characters, occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, held = Roller(0x9E3779B97F4A7C15), {}

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for _, data, offsets in text_slices(batch.column(0)):
                x = _LETTERS[data]
                start, end, _ = word_spans(x, offsets)
                roller.load(x.astype(np.uint64))
                _, one, n = np.unique(roller.of(start, end), return_index=True, return_counts=True)
                whole = x.tobytes()
                for a, b, c in zip(start[one].tolist(), end[one].tolist(), n.tolist()):
                    word = whole[a:b]
                    held[word] = held.get(word, 0) + c
            if len(held) > HELD:
                yield flush()
                held.clear()
        yield flush()

    return docs.where("text is not null").select(F.lower("text").alias("text")).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def viterbi(label: str, counts: dict[str, int], total: int) -> list[str]:
    """The most probable split; of equals the one with fewer words, then with the longer last word.

    A word that doesn't occur has the probability 10 / (total * 10 ** length), as one too rare to be seen.
    """
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
    unseen: tuple[float, int, int] = (-math.inf, 0, 0)  # the best split whose last word doesn't occur
    base, longest = math.log(max(total, 1)), max(map(len, counts), default=0)
    for i in range(1, len(label) + 1):
        score, words, at = best[i - 1]
        unseen = max((unseen[0] - math.log(10), unseen[1], unseen[2]), (score - base, words - 1, 1 - i))
        options = [unseen]
        for j in range(max(0, i - longest), i):
            n = counts.get(label[j:i])
            if n:
                options.append((best[j][0] + math.log(n) - base, best[j][1] - 1, -j))
        best.append(max(options))
    out, i = [], len(label)
    while i:
        j = -best[i][2]
        out.append(label[j:i])
        i = j
    return out[::-1]


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def segment(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """label, words for every distinct label of the column `label`; an empty one has no words, one of more than LABEL letters is a word."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    labels = labels.where("label is not null").select("label").distinct()
    ends = labels.where(F.length("label").between(1, LABEL)).select("label", F.explode(F.sequence(F.lit(1), F.length("label"))).alias("i"))
    parts = ends.select("label", F.explode(F.transform(F.sequence(F.lit(1), F.length("label") - F.col("i") + 1), lambda k: F.substring("label", F.col("i"), k))).alias("word")).distinct()
    found = parts.join(counts, "word").groupBy("label").agg(F.collect_list(F.struct("word", "n")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [viterbi(label, {w["word"]: w["n"] for w in seen or ()}, total) if len(label) <= LABEL else [label] for label, seen in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.string()))], ["label", "words"])

    return labels.join(found, "label", "left").select("label", "found").mapInArrow(run, "label string, words array<string>")


def url_tokens(pages: DataFrame, counts: DataFrame) -> DataFrame:
    """page_id, url, host, words, tokens, linked of every page; tokens are words of the host and parts of the path.

    Path parts are runs of letters and digits, in small letters; runs of digits alone are NUMBER. `linked` is the
    last number of the path. A null url has a null host, no words and no tokens.
    """
    path = _path(F.col("url"))
    raw = F.filter(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    tokens = F.transform(raw, lambda t: F.when(t.rlike(r"^\p{N}+$"), F.lit(NUMBER)).otherwise(t))
    digits = F.regexp_extract(path, r"(?s)^.*?(?<![0-9])([0-9]{1,19})(?![0-9])[^0-9]*$", 1)
    rows = pages.select(
        "page_id",
        "url",
        _host(F.col("url")).alias("host"),
        F.coalesce(tokens, F.array().cast("array<string>")).alias("path"),
        F.when(digits != "", digits).try_cast("bigint").alias("linked"),
    )
    rows = rows.withColumn("labels", F.filter(F.split("host", r"[.-]+"), lambda t: t != ""))
    hosts = rows.where("host is not null").select("host", "labels").distinct()
    each = hosts.select("host", F.posexplode("labels").alias("i", "label"))
    words = each.join(segment(each.select("label"), counts), "label").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("i", "words"))).alias("split"))
    words = words.select("host", F.flatten(F.transform("split", lambda s: s["words"])).alias("words"))
    none = F.array().cast("array<string>")
    joined = rows.join(words, "host", "left").withColumn("words", F.coalesce("words", none))
    return joined.select("page_id", "url", "host", "words", F.concat("words", "path").alias("tokens"), "linked")


def filter_urls(pages: DataFrame, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, url, host, words (joined by spaces), score (log-odds of the class to be blocked), blocked (score above 0).

    Every row of pages gives a row. A null or token-free url scores the log-odds of the classes alone; without labels of
    both classes every score is 0. A doc_id labelled several times counts once, with its lowest quality; null
    labels don't count. Repeated rows stay. Other columns are ignored; an empty table gives an empty result.
    """
    # both are read several times
    tokens = materialize(url_tokens(pages, materialize(word_counts(docs))))
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("bigint").alias("linked")).agg((F.min("quality") == 0).alias("low"))
    taught = tokens.where("linked is not null").join(known, "linked").select("low", "tokens")
    marks = taught.agg(F.count_if("low").alias("low"), F.count_if(~F.col("low")).alias("high")).first()
    if not marks["low"] or not marks["high"]:
        return tokens.select("page_id", "url", "host", F.array_join("words", " ").alias("words"), F.lit(0.0).alias("score"), F.lit(False).alias("blocked"))
    seen = taught.select("low", F.explode("tokens").alias("token")).groupBy("token").agg(F.count_if("low").alias("low"), F.count_if(~F.col("low")).alias("high"))
    sums = seen.agg(F.sum("low").alias("low"), F.sum("high").alias("high"), F.count("*").alias("size")).first()
    size = (sums["size"] or 0) + 1  # one more for what was never seen
    low, high = (sums["low"] or 0) + ALPHA * size, (sums["high"] or 0) + ALPHA * size
    unseen = math.log(ALPHA / low) - math.log(ALPHA / high)
    weights = seen.select("token", (F.log((F.col("low") + ALPHA) / low) - F.log((F.col("high") + ALPHA) / high)).alias("weight"))
    # equal token lists score alike: the sums are made once for each
    lists = tokens.select("tokens").distinct()
    scored = lists.select("tokens", F.explode("tokens").alias("token")).join(weights, "token", "left").groupBy("tokens").agg(F.sum(F.coalesce("weight", F.lit(unseen))).alias("sum"))
    prior = math.log(marks["low"] / marks["high"])
    out = tokens.join(scored, "tokens", "left").withColumn("score", F.round(F.coalesce("sum", F.lit(0.0)) + prior, 9))
    return out.select("page_id", "url", "host", F.array_join("words", " ").alias("words"), "score", (F.col("score") > 0).alias("blocked"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

"""Lists and dumps of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigspark.functions.terms import canonical_windows, num_terms, pad_index, windows
from sigspark.plans.storage import numbered
from sigspark.sources.files import documents

ORDERS = {"path": ["path", "subdoc_index"], "size": ["size", "path", "subdoc_index"]}


def listed(segments: DataFrame, k: int = 31, order: str = "path") -> DataFrame:
    """Documents with their number, doc_id, by path or by size."""
    return numbered(documents(segments, k), ORDERS[order], "doc_id")


def summary(docs: DataFrame, column: str = "num_terms") -> DataFrame:
    """count, min, max, avg (cut to an integer) and total of a column."""
    c = F.col(column)
    return docs.agg(F.count("*").alias("count"), F.min(c).alias("min"), F.max(c).alias("max"), F.floor(F.avg(c)).cast("bigint").alias("avg"), F.sum(c).cast("bigint").alias("total"))


def dump(segments: DataFrame, k: int = 31, canonicalize: bool = True) -> DataFrame:
    """Every term of every document, with valid where canonical."""
    own = segments.select("path", "subdoc_index", "name", "seq")
    return canonical_windows(own, k) if canonicalize else windows(own, k)


def batches(docs: DataFrame, size: int) -> DataFrame:
    """Numbered documents with batch and its name, %06d_[first-last]."""
    out = docs.withColumn("batch", F.floor(F.col("doc_id") / size).cast("bigint"))
    names = out.groupBy("batch").agg(F.min_by("name", "doc_id").alias("a"), F.max_by("name", "doc_id").alias("b"))
    names = names.select("batch", F.concat(pad_index(F.col("batch")), F.lit("_["), "a", F.lit("-"), "b", F.lit("]")).alias("batch_name"))
    return out.join(names, "batch")


def length_histogram(segments: DataFrame) -> DataFrame:
    """How many sequences have each length."""
    return segments.where("seq is not null").groupBy(F.octet_length("seq").cast("bigint").alias("length")).agg(F.count("*").alias("n"))


def terms_of_histogram(histogram: DataFrame, k: int) -> DataFrame:
    return histogram.agg(F.sum(num_terms(F.col("length"), k) * F.col("n")).cast("bigint").alias("num_terms"))

"""Stored indices: Parquet tables under one path, and the API over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.model import ClassicParams, CompactParams, Meta
from sigspark.operators import build, search
from sigspark.operators.build import Tables
from sigspark.plans.storage import drop, file_system, new_path
from sigspark.sources.files import read_files, read_queries


def write(tables: Tables, path: str, mode: str = "errorifexists") -> None:
    """Bits are ranged and sorted by (page_id, row_idx), so that a scan for few rows skips the other row groups.

    meta is written last: an index without it is not whole and doesn't open. Modes: errorifexists refuses any
    path that exists; overwrite replaces an index, whole or not; ignore keeps a whole index and finishes one that
    isn't. What is no index is never written over.
    """
    spark = tables.bits.sparkSession
    if mode not in ("errorifexists", "overwrite", "ignore"):
        raise ValueError(f"unknown mode {mode!r}")
    hadoop, fs = file_system(spark, path)
    if fs.exists(hadoop):
        if mode == "errorifexists":
            raise FileExistsError(path)
        names = {s.getPath().getName() for s in fs.listStatus(hadoop)} if fs.getFileStatus(hadoop).isDirectory() else {path}
        if names - {"begun", "docs", "pages", "bits", "meta"} or (names and "begun" not in names):
            raise FileExistsError(f"{path} is no index")
        if mode == "ignore" and exists(spark, path):
            return
    if mode == "overwrite":  # what is overwritten may be read by these tables: they go elsewhere first
        held = new_path(spark)
        _put(tables, held)
        tables = read(spark, held)
        drop(spark, [f"{path}/meta"])
    _put(tables, path)
    if mode == "overwrite":
        drop(spark, [held])


def _put(tables: Tables, path: str) -> None:
    spark = tables.bits.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hadoop, fs = file_system(spark, f"{path}/begun")
    fs.mkdirs(hadoop)
    tables.docs.write.mode("overwrite").parquet(f"{path}/docs")
    tables.pages.write.mode("overwrite").parquet(f"{path}/pages")
    tables.bits.repartitionByRange(parts, "page_id", "row_idx").sortWithinPartitions("page_id", "row_idx", "word_idx").write.mode("overwrite").parquet(f"{path}/bits")
    spark.createDataFrame([tables.meta.row()], "layout string, term_size int, canonicalize boolean, num_hashes int, family string, num_docs bigint, page_docs bigint").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def exists(spark: SparkSession, path: str) -> bool:
    hadoop, fs = file_system(spark, f"{path}/meta/_SUCCESS")
    return fs.exists(hadoop)


def read(spark: SparkSession, path: str) -> Tables:
    if not exists(spark, path):
        raise FileNotFoundError(f"no index at {path}")
    row = spark.read.json(f"{path}/meta").first().asDict()
    return Tables(Meta(**{k: row[k] for k in Meta.__dataclass_fields__}), *(spark.read.parquet(f"{path}/{t}") for t in ("pages", "docs", "bits")))


class Index:
    """One or several stored indices, searched together."""

    def __init__(self, spark: SparkSession, tables: Sequence[Tables]):
        self.spark, self.tables = spark, list(tables)

    @classmethod
    def load(cls, spark: SparkSession, *paths: str, preload: bool = False) -> Index:
        found = [read(spark, p) for p in paths]
        if preload:
            found = [Tables(t.meta, t.pages, t.docs, t.bits.persist()) for t in found]
        return cls(spark, found)

    def search(self, queries: DataFrame | str | bytes, threshold: float = 0.0, limit: int = 0, on_short: str = "error") -> DataFrame:
        """Results by query and rank. One string is query 0, for which only its rows of the index are read."""
        single = isinstance(queries, str | bytes)
        if single:
            raw = queries.encode() if isinstance(queries, str) else queries
            queries = self.spark.createDataFrame([(0, bytearray(raw))], "query_id bigint, query binary")
        out = search.search(queries, self.tables, threshold, limit, on_short, 10_000 if single else 0)
        return out.orderBy("query_id", "rank") if single else out


def construct_classic(spark: SparkSession, source: str | DataFrame, path: str, params: ClassicParams = ClassicParams(), file_type: str = "any", mode: str = "errorifexists") -> None:
    """source: a file, list file or directory, or segments."""
    segments = read_files(spark, source, file_type) if isinstance(source, str) else source
    write(build.build_classic(segments, params), path, mode)


def construct_compact(spark: SparkSession, source: str | DataFrame, path: str, params: CompactParams = CompactParams(), file_type: str = "any", mode: str = "errorifexists") -> None:
    segments = read_files(spark, source, file_type) if isinstance(source, str) else source
    write(build.build_compact(segments, params), path, mode)


def combine_classic(spark: SparkSession, paths: list[str], path: str, mode: str = "errorifexists") -> None:
    """Documents go in the order of the paths by name."""
    write(build.combine_classic([read(spark, p) for p in sorted(paths)]), path, mode)


def combine_compact(spark: SparkSession, paths: list[str], path: str, page_size: int = 8192, mode: str = "errorifexists") -> None:
    write(build.combine_compact([read(spark, p) for p in sorted(paths)], page_size), path, mode)


def search_file(index: Index, path: str, threshold: float = 0.0, limit: int = 0) -> DataFrame:
    """Lines of text for the queries of a file: of each *comment and its number of results, then these."""
    queries = read_queries(index.spark, path)
    return result_lines(index.search(queries.drop("comment"), threshold, limit), queries)


def result_lines(results: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Lines of text: name and score; with a batch of queries, first *comment and the number of results of each."""
    lines = results.select("query_id", F.col("rank").cast("bigint").alias("n"), F.concat_ws("\t", "doc_name", F.col("score").cast("string")).alias("value"))
    if queries is not None:
        counts = queries.join(results.groupBy("query_id").agg(F.count("*").alias("c")), "query_id", "left")
        heads = counts.select("query_id", F.lit(0).cast("bigint").alias("n"), F.concat(F.lit("*"), "comment", F.lit("\t"), F.coalesce("c", F.lit(0)).cast("string")).alias("value"))
        lines = heads.unionByName(lines)
    return lines.orderBy("query_id", "n").select("value")

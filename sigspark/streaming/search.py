"""Streams of queries against a static index, and documents that arrive as new indices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sigspark.model import ClassicParams
from sigspark.operators import build, search
from sigspark.operators.build import Tables
from sigspark.plans import index
from sigspark.plans.storage import file_system


def search_stream(queries: DataFrame, indices: list[Tables], sink: str, checkpoint: str, threshold: float = 0.8, limit: int = 0) -> StreamingQuery:
    """Results of a stream of (query_id, query), one folder for each micro-batch: a batch that is done again replaces its own."""

    def batch(rows: DataFrame, number: int) -> None:
        search.search(rows, indices, threshold, limit, on_short="skip").write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_stream(segments: DataFrame, folder: str, checkpoint: str, params: ClassicParams = ClassicParams()) -> StreamingQuery:
    """A stream of segments; every micro-batch becomes a classic index of its own, to be searched together with the others."""

    def batch(rows: DataFrame, number: int) -> None:
        index.write(build.build_classic(rows, params), f"{folder}/{number:08d}", "overwrite")

    return segments.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load_all(spark: SparkSession, folder: str) -> index.Index:
    """All indices of a folder, in the order of their names."""
    hadoop, fs = file_system(spark, folder)
    paths = sorted(str(s.getPath().toString()) for s in fs.listStatus(hadoop))
    return index.Index.load(spark, *[p for p in paths if index.exists(spark, p)])

"""Tables in the folder that all executors share, and distributed numbering."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Folders of this process that haven't been dropped, oldest first.
_written: list[str] = []


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB at most: a Python worker holds several, and rows may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only in one JVM, as in tests, may it be unset: then it is a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="sigspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """Hadoop's path and its file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession) -> str:
    """A new folder, in one of the application's that goes when the application ends."""
    base = f"{shared_dir(spark)}/sigspark-{spark.sparkContext.applicationId}"
    hadoop, fs = file_system(spark, base)
    fs.mkdirs(hadoop)  # only what exists can be marked
    fs.deleteOnExit(hadoop)
    path = f"{base}/{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders that materialize() wrote; nothing that reads them may be run any more."""
    for path in paths:
        hadoop, fs = file_system(spark, path)
        fs.delete(hadoop, True)
        if path in _written:
            _written.remove(path)


def written() -> set[str]:
    """Folders of materialize() that are there."""
    return set(_written)


def settled(spark: SparkSession, make: Callable[[], DataFrame], before: set[str] | None = None) -> DataFrame:
    """What make() returns, materialized; all other folders that are not in `before`, by default those written on the way there, are dropped."""
    before = set(_written) if before is None else before
    out = materialize(make())
    drop(spark, [p for p in _written if p not in before][:-1])
    return out


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with its position, from 0, in the order of these columns.

    Range partitions are numbered on their own and moved by what lies before them: no partition sees
    all rows. df is written once, since positions must not change when a task runs again.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each partition
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return placed.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(name, (F.col("_own") + F.col("_before")).cast("bigint")).drop("_part", "_own", "_before")

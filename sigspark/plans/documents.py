"""Lists of documents: an object over segments, for use from Python."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession

from sigspark.operators import listing
from sigspark.plans.storage import materialize
from sigspark.sources.files import SCHEMA, read_files


class DocumentList:
    """Documents of files and folders, in an order. Rows have doc_id, path, name, file_type, size, subdoc_index and num_terms."""

    def __init__(self, spark: SparkSession, root: str | None = None, file_type: str = "any", k: int = 31):
        self.spark, self.k, self.order = spark, k, "path"
        self.segments = spark.createDataFrame([], SCHEMA) if root is None else read_files(spark, root, file_type)
        self._listed: DataFrame | None = None

    def add(self, path: str, file_type: str = "any") -> None:
        """A file, a list file or, recursively, a folder."""
        self.segments, self._listed = self.segments.unionByName(read_files(self.spark, path, file_type)), None

    def sort_by_path(self) -> None:
        self.order, self._listed = "path", None

    def sort_by_size(self) -> None:
        self.order, self._listed = "size", None

    @property
    def documents(self) -> DataFrame:
        if self._listed is None:
            self._listed = materialize(listing.listed(self.segments, self.k, self.order))
        return self._listed

    def size(self) -> int:
        return self.documents.count()

    __len__ = size

    def __getitem__(self, i: int) -> Row:
        n = len(self)
        found = self.documents.where(f"doc_id = {i + n if i < 0 else i}").first()
        if found is None:
            raise IndexError(i)
        return found

    def __iter__(self) -> Iterator[Row]:
        """One by one, a partition at a time."""
        return self.documents.orderBy("doc_id").toLocalIterator()

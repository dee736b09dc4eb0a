"""Files to segments: path, file_type, name, subdoc_index, size, seq.

A segment is a stretch of bytes that windows don't cross. Text files stay in the JVM; the others are
decoded a file at a time in Arrow batches. Files are read whole, at most 2 GB each (the limit of a binary value).
"""

from __future__ import annotations

import gzip
import logging
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.functions.terms import base_name, num_terms, pack_kmers, unpack_kmers
from sigspark.model import FILE_TYPES, file_type_named

SCHEMA = "path string, file_type string, name string, subdoc_index int, size bigint, seq binary"
_PATTERNS = [
    ("text", r"\.txt$"),
    ("cortex", r"\.(ctx|cortex)$"),
    ("kmers", r"\.[a-z]+_doc$"),
    ("mfasta", r"\.mfasta$"),
    ("mfastq", r"\.mfastq$"),
    ("fasta", r"\.(fa|fasta|fna|ffn|faa|frn)(\.gz)?$"),
    ("fastq", r"\.(fq|fastq)(\.gz)?$"),
    ("list", r"\.list$"),
]


def sniff(path: Column) -> Column:
    """A file's type by its extension; "any" if unknown."""
    out = F.lit("any")
    for name, pattern in reversed(_PATTERNS):
        out = F.when(path.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def accepted(file_type: Column, wanted: str = "any") -> Column:
    return file_type.isin(*FILE_TYPES) if wanted == "any" else file_type == wanted


class FormatError(ValueError):
    pass


def fasta(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(header, sequence); headers, comments and blank lines end a sequence, line breaks don't."""
    lines = data.split(b"\n")
    if not lines[0].startswith((b">", b";")):
        raise FormatError("a FASTA file begins with > or ;")
    header, held = "", []
    for line in lines:
        line = line.rstrip(b"\r")
        if not line or line.startswith((b">", b";")):
            if held:
                yield header, b"".join(held)
                held = []
            if line:
                header = line[1:].decode("latin1")
        else:
            held.append(line)
    if held:
        yield header, b"".join(held)


def multi_fasta(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(header, residues) of each > record; a comment ends its residues."""
    header, held, on = None, [], False
    for line in data.split(b"\n"):
        line = line.rstrip(b"\r")
        if line.startswith(b">"):
            if header is not None:
                yield header, b"".join(held)
            header, held, on = line[1:].decode("latin1"), [], True
        elif line.startswith(b";"):
            on = False
        elif header is None and line:
            raise FormatError("a FASTA file begins with > or ;")
        elif on:
            held.append(line)
    if header is not None:
        yield header, b"".join(held)


def fastq(data: bytes) -> Iterator[tuple[str, bytes]]:
    lines = [x.rstrip(b"\r") for x in data.split(b"\n")]
    while lines and not lines[-1]:
        lines.pop()
    if len(lines) % 4:
        raise FormatError("a FASTQ file has four lines a read")
    for at in range(0, len(lines), 4):
        if not lines[at].startswith(b"@") or not lines[at + 2].startswith(b"+"):
            raise FormatError("a FASTQ read begins with @ and has + in its third line")
        yield lines[at][1:].decode("latin1"), lines[at + 1]


def cortex(data: bytes) -> tuple[str, int, np.ndarray]:
    """(document name, k, (n, k) letters) of a version 6 graph of one colour."""
    if data[:6] != b"CORTEX":
        raise FormatError("no graph file")
    version, k, words, colours = struct.unpack_from("<IIII", data, 6)
    if version != 6 or colours != 1:
        raise FormatError("only version 6 with one colour is read")
    at = 22 + 12
    (n,) = struct.unpack_from("<I", data, at)
    name = data[at + 4 : at + 4 + n].decode("latin1")
    at += 4 + n + 16 + 12
    (n,) = struct.unpack_from("<I", data, at)
    at += 4 + n
    if data[at : at + 6] != b"CORTEX":
        raise FormatError("the header doesn't end")
    at += 6
    width = 8 * words + 5
    count = (len(data) - at) // width
    rows = np.frombuffer(data, np.uint8, count * width, at).reshape(count, width)
    return name, k, unpack_kmers(rows[:, : 8 * words], k)


def packed_document(data: bytes) -> tuple[str, int, np.ndarray]:
    """(document name, k, (n, k) letters) of a file of packed k-mers: five letters, DOCUMENT, version, k, name."""
    if data[5:13] != b"DOCUMENT" or struct.unpack_from("<I", data, 13)[0] != 1:
        raise FormatError("no packed document")
    (k,) = struct.unpack_from("<I", data, 17)
    if not k:
        raise FormatError("k is 0")
    end = data.index(b"\0", 21)
    name = data[21:end].decode("latin1")
    if data[end + 1 : end + 9] != b"DOCUMENT":
        raise FormatError("the header doesn't end")
    width = -(-k // 4)
    body = np.frombuffer(data, np.uint8, offset=end + 9)
    return name, k, unpack_kmers(body[: len(body) // width * width].reshape(-1, width), k)


def packed_bytes(name: str, k: int, packed: bytes, magic: bytes = b"SIGSP") -> bytes:
    """A file of packed k-mers, as packed_document() reads it."""
    return magic + b"DOCUMENT" + struct.pack("<II", 1, k) + name.encode("latin1") + b"\0DOCUMENT" + packed


def write_packed(segments: DataFrame, k: int, folder: str) -> DataFrame:
    """A file of packed k-mers, `name`.sig_doc, for each document; returns path and n_terms of each.

    Only windows of A, C, G and T alone are k-mers. A document's k-mers are packed in order, by the task that holds
    its sequences, straight to its file; a document without one has a file without any.
    """
    spark = segments.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if path.toUri().getScheme() not in (None, "file"):
        raise ValueError("packed files are written to a file system that is mounted on all executors")
    root = path.toUri().getPath()
    letters = np.isin(np.arange(256), np.frombuffer(b"ACGT", np.uint8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(root, exist_ok=True)
        file, now, n = None, None, 0
        for batch in batches:
            for where, sub, name, seq in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (where, sub) != now:
                    if file:
                        file.close()
                        os.replace(file.name, file.name[:-4])
                        yield pa.RecordBatch.from_pylist([{"path": file.name[:-4], "n_terms": n}])
                    now, n = (where, sub), 0
                    file = open(f"{root}/{name}.sig_doc.tmp", "wb")
                    file.write(packed_bytes(name, k, b""))
                x = np.frombuffer(seq or b"", np.uint8)
                if len(x) >= k:
                    windows = np.lib.stride_tricks.sliding_window_view(x, k)
                    for at in range(0, len(windows), 1 << 16):
                        some = windows[at : at + (1 << 16)]
                        some = some[letters[some].all(1)]
                        file.write(pack_kmers(some).tobytes())
                        n += len(some)
        if file:
            file.close()
            os.replace(file.name, file.name[:-4])
            yield pa.RecordBatch.from_pylist([{"path": file.name[:-4], "n_terms": n}])

    rows = segments.select("path", "subdoc_index", "name", "seq").repartition("path", "subdoc_index").sortWithinPartitions("path", "subdoc_index")
    return rows.mapInArrow(run, "path string, n_terms bigint")


def _decode(kind: str, name: str, size: int, data: bytes) -> Iterator[tuple[str, int, int, bytes]]:
    """(name, subdoc_index, size, seq); a document without sequences has one null seq."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    if kind in ("mfasta", "mfastq"):
        for i, (_, seq) in enumerate(multi_fasta(data) if kind == "mfasta" else fastq(data)):
            yield f"{name}_{i:06d}", i, len(seq), seq
        return
    if kind in ("cortex", "kmers"):
        name, _, letters = (cortex if kind == "cortex" else packed_document)(data)
        found = [row.tobytes() for row in letters]
    else:
        found = [seq for _, seq in (fasta if kind == "fasta" else fastq)(data)]
    for seq in found or [None]:
        yield name, 0, size, seq


def list_paths(lines: DataFrame, base: str) -> DataFrame:
    """path of every line (value) of a list file; relative ones lie in base, blank lines and those that begin with # don't count."""
    one = lines.where("trim(value) <> '' and not startswith(value, '#')").select(F.trim("value").alias("path"))
    absolute = F.startswith("path", F.lit("/")) | F.contains("path", F.lit("://"))
    return one.select(F.when(absolute, F.col("path")).otherwise(F.concat(F.lit(f"{base}/"), "path")).alias("path"))


def _listed(spark: SparkSession, path: str) -> list[str]:
    base = path.rsplit("/", 1)[0] if "/" in path else "."
    return [r.path for r in list_paths(spark.read.text(path), base).collect()]


def is_list(path: str, wanted: str) -> bool:
    return path.endswith(".list") or wanted == "list"


def read_files(spark: SparkSession, path: str, file_type: str = "any", skip_broken: bool | None = None) -> DataFrame:
    """Segments of a file, a list file or, recursively, a directory.

    In a directory only files of the wanted type count and broken ones are logged and left out; a
    single file, or one in a list, is read by its extension and an error in it fails the query, unless skip_broken.
    A document without a window-bearing sequence has a row with a null seq.
    """
    wanted = file_type_named(file_type)
    if is_list(path, wanted):
        paths, single = _listed(spark, path), True
        raw = spark.read.format("binaryFile").load(paths) if paths else spark.createDataFrame([], "path string, modificationTime timestamp, length bigint, content binary")
    else:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        single = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile()
    skip = not single if skip_broken is None else skip_broken
    plain = F.regexp_replace("path", "^file:/+", "/")
    typed = raw.select(plain.alias("path"), sniff(F.col("path")).alias("file_type"), F.col("length").alias("size"), "content").withColumn("name", base_name(F.col("path")))
    typed = typed.where(accepted(F.col("file_type"), "any" if single else wanted))
    return decoded(typed, skip)


def decoded(files: DataFrame, skip_broken: bool = False) -> DataFrame:
    """Segments of path, file_type, name, size, content."""
    text = files.where("file_type = 'text'").select("path", "file_type", "name", F.lit(0).alias("subdoc_index"), "size", F.col("content").alias("seq"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "file_type", "name", "subdoc_index", "size", "seq"]
        types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
        def made(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names)

        for batch in batches:
            held, size = [], 0  # of many small files, results go on together
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("path", "file_type", "name", "size")]
            content = batch.column(batch.schema.get_field_index("content"))
            for i, (path, kind, name, length) in enumerate(zip(*(c.to_pylist() for c in columns))):
                try:
                    found = [(path, kind, *f) for f in _decode(kind, name, length, content[i].as_py())]
                except (FormatError, struct.error, ValueError, OSError, EOFError, zlib.error) as error:
                    if not skip_broken:
                        raise
                    logging.getLogger("sigspark").warning("%s is left out: %s", path, error)
                    continue
                held += found
                size += sum(len(f[-1] or b"") + 64 for f in found)
                if size > 1 << 22:
                    yield made(held)
                    held, size = [], 0
            if held:
                yield made(held)

    rest = files.where("file_type <> 'text'").select("path", "file_type", "name", "size", "content").mapInArrow(decode, SCHEMA)
    return text.unionByName(rest)


def from_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """Segments of a table: a document for each row, named by its key; a null text is a document without terms.

    The order of documents, by (path, subdoc_index), is that of the keys read as text of 20 digits where they are numbers.
    """
    name = F.col(key).cast("string")
    number = df.schema[key].dataType.typeName() in ("long", "integer", "short", "byte")
    path = F.lpad(name, 20, "0") if number else name
    seq = F.col(text).cast("binary")
    return df.select(path.alias("path"), F.lit("text").alias("file_type"), name.alias("name"), F.lit(0).alias("subdoc_index"), F.coalesce(F.octet_length(seq), F.lit(0)).cast("bigint").alias("size"), seq.alias("seq"))


def documents(segments: DataFrame, k: int, *more: Column) -> DataFrame:
    """A row for each document: path, subdoc_index, file_type, name, size, num_terms, and more aggregates."""
    return segments.groupBy("path", "subdoc_index").agg(
        F.first("file_type").alias("file_type"), F.first("name").alias("name"), F.first("size").alias("size"), F.sum(F.coalesce(num_terms(F.octet_length("seq"), k), F.lit(0))).cast("bigint").alias("num_terms"), *more
    )


def parse_queries(lines: Iterator[str]) -> Iterator[tuple[str, str]]:
    """(comment, query) of a FASTA-like query file; without a comment before it, the comment is empty."""
    comment, held = "", []
    for line in lines:
        if line[:1] in (">", ";"):
            if held:
                yield comment, "".join(held)
                held = []
            comment = line[1:]
        elif line:
            held.append(line)
    if held:
        yield comment, "".join(held)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """query_id (from 0, in file order), comment, query of a query file."""
    raw = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (content,) in zip(batch.column(0).to_pylist()):
                found = list(parse_queries(x.rstrip("\r") for x in content.decode("latin1").split("\n")))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(found)), pa.int64()), pa.array([c for c, _ in found], pa.string()), pa.array([q.encode("latin1") for _, q in found], pa.binary())], ["query_id", "comment", "query"]
                )

    return raw.mapInArrow(run, "query_id bigint, comment string, query binary")


def query_lines(queries: DataFrame) -> DataFrame:
    """value: the lines of a query file for comment and query, two for each."""
    return queries.select(F.explode(F.array(F.concat(F.lit(">"), "comment"), F.col("query").cast("string"))).alias("value"))


def write_queries(queries: DataFrame, path: str, compression: str = "none") -> None:
    """A query file, or several in a folder where queries have several partitions; compression: none, gzip and so on."""
    query_lines(queries).write.option("compression", compression).text(path)

"""Building signature indices.

An index is three tables. pages: page_id, signature_size. docs: doc_id, page_id, slot, name, ... bits: page_id,
row_idx, word_idx, bits, where bit b of word w of a row belongs to the document in slot 64 w + b; rows and words
without a bit are absent. Terms are generated, hashed and OR-ed in one shuffle of (page, row, word) with
partial aggregation; term bytes never travel.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspark.functions.hashing import term_row
from sigspark.functions.sizing import page_size, signature_size, signature_size_col
from sigspark.functions.terms import terms
from sigspark.model import ClassicParams, CompactParams, Meta
from sigspark.operators import scan
from sigspark.operators.scan import Source
from sigspark.plans.storage import materialize, numbered
from sigspark.sources.files import documents

WORD = 64


@dataclass(frozen=True)
class Tables:
    """An index as DataFrames."""

    meta: Meta
    pages: DataFrame
    docs: DataFrame
    bits: DataFrame
    #: Of an index that isn't stored: bits of these (page_id, row_idx) alone, so that the other terms never travel.
    narrowed: Callable[[DataFrame], DataFrame] | None = None
    #: Of such an index as well: what it is built from; of one that such indices are combined in, each with how far its doc_ids are moved.
    source: Source | None = None
    parts: tuple[tuple[Tables, int], ...] = ()

    def bits_of(self, rows: DataFrame) -> DataFrame:
        """bits, or what is needed of them, for the rows (page_id, row_idx) that a search touches."""
        return self.narrowed(rows.select("page_id", "row_idx").distinct()) if self.narrowed else self.bits

    def only(self, paths: DataFrame) -> Tables:
        """The same index, of which only the documents of these paths are scored; not of a stored one."""
        return replace(self, source=replace(self.source, segments=self.source.segments.join(paths, "path", "left_semi")))


def bit_words(placed: DataFrame, params: ClassicParams | CompactParams, only: DataFrame | None = None) -> DataFrame:
    """placed: page_id, slot, signature_size, seq; only: the (page_id, row_idx) that are wanted, by default all."""
    found = terms(placed, params.term_size, params.canonicalize)
    size = F.col("signature_size")
    rows = [term_row(F.col("term"), j, size, params.family) for j in range(params.num_hashes)]
    word = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("slot", F.lit(WORD)).cast("int"))
    one = found.select("page_id", F.floor(F.col("slot") / WORD).cast("int").alias("word_idx"), word.alias("bit"), F.explode(F.array(*rows)).alias("row_idx"))
    if only is not None:
        one = one.join(only, ["page_id", "row_idx"], "left_semi")
    return one.groupBy("page_id", "row_idx", "word_idx").agg(F.bit_or("bit").alias("bits"))


def _placed(segments: DataFrame, docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Segments with their place. Documents are few beside their text: they are joined to it, by broadcast if small."""
    where = docs.join(F.broadcast(pages) if pages.isLocal() else pages, "page_id").select("path", "subdoc_index", "page_id", "slot", "signature_size")
    return segments.where("seq is not null").select("path", "subdoc_index", "seq").join(where, ["path", "subdoc_index"]).select("page_id", "slot", "signature_size", "seq")


def _largest() -> Column:
    return F.max_by("num_terms", F.struct("size", "path", "subdoc_index"))


def classic_size(docs: DataFrame, params: ClassicParams) -> int:
    """From the terms of the largest document by bytes; of equals, the last by path."""
    return _size_of(docs.agg(_largest()).first()[0], params)


def _size_of(n: int | None, params: ClassicParams) -> int:
    return max(1, signature_size(n or 0, params.num_hashes, params.false_positive_rate))


def build_classic(segments: DataFrame, params: ClassicParams = ClassicParams()) -> Tables:
    counted = materialize(numbered(_with_segments(segments, params), ["path", "subdoc_index"], "doc_id").withColumns({"page_id": F.lit(0), "slot": F.col("doc_id")}))
    n, most, largest = counted.agg(F.count("*"), F.max("_segments"), _largest()).first()
    docs = counted.drop("_segments")
    size = params.signature_size or _size_of(largest, params)
    pages = segments.sparkSession.createDataFrame([(0, size)], "page_id int, signature_size bigint")
    return _built(Meta("classic", params.term_size, params.canonicalize, params.num_hashes, params.family, n, n), segments, docs, pages, params, size, (most or 0) <= 1)


def _with_segments(segments: DataFrame, params: ClassicParams | CompactParams) -> DataFrame:
    """Documents, with how many segments they have."""
    return documents(segments, params.term_size, F.count("*").alias("_segments"))


def _built(meta: Meta, segments: DataFrame, docs: DataFrame, pages: DataFrame, params: ClassicParams | CompactParams, size: int | None, single: bool) -> Tables:
    placed = _placed(segments, docs, pages)
    return Tables(meta, pages, docs, bit_words(placed, params), lambda rows: bit_words(placed, params, rows), Source(segments, docs, pages, params, size, single))


def paged(docs: DataFrame, page_docs: int) -> DataFrame:
    """Documents, by (size, path), in pages of page_docs; slots and doc_id go by path within a page."""
    return _paged(numbered(docs, ["size", "path", "subdoc_index"], "_rank"), page_docs)


def _paged(ranked: DataFrame, page_docs: int) -> DataFrame:
    by_size = ranked.withColumn("page_id", F.floor(F.col("_rank") / page_docs).cast("int"))
    slot = F.row_number().over(Window.partitionBy("page_id").orderBy("path", "subdoc_index")) - 1
    return by_size.withColumn("slot", slot.cast("bigint")).withColumn("doc_id", F.col("page_id").cast("bigint") * page_docs + F.col("slot")).drop("_rank")


def page_sizes(docs: DataFrame, params: CompactParams) -> DataFrame:
    """From the most terms of a document of the page; a page without terms keeps its documents."""
    return docs.groupBy("page_id").agg(F.greatest(F.lit(1).cast("bigint"), signature_size_col(F.max("num_terms"), params.num_hashes, params.false_positive_rate)).alias("signature_size"))


def build_compact(segments: DataFrame, params: CompactParams = CompactParams()) -> Tables:
    ranked = numbered(_with_segments(segments, params), ["size", "path", "subdoc_index"], "_rank")
    n, most = ranked.agg(F.count("*"), F.max("_segments")).first()
    width = 8 * (params.page_size or page_size(n))
    docs = materialize(_paged(ranked.drop("_segments"), width))
    return _built(Meta("compact", params.term_size, params.canonicalize, params.num_hashes, params.family, n, width), segments, docs, page_sizes(docs, params), params, None, (most or 0) <= 1)


def _same(tables: list[Tables], *names: str) -> None:
    for name in names:
        found = {getattr(t.meta, name) for t in tables}
        if len(found) > 1:
            raise ValueError(f"indices differ in {name}: {sorted(map(str, found))}")


def combine_classic(tables: list[Tables]) -> Tables:
    """Documents of the indices, in their order, side by side in one page; all must have one signature size."""
    _same(tables, "term_size", "canonicalize", "num_hashes", "family")
    spark = tables[0].bits.sparkSession
    sizes = [t.pages.collect() for t in tables]  # a row each
    if any(len(s) != 1 for s in sizes) or len({s[0].signature_size for s in sizes}) > 1:
        raise ValueError("classic indices of one signature size are needed")
    docs, words, parts, offset = [], [], [], 0
    for t in tables:
        parts.append((t, offset))
        docs.append(t.docs.withColumns({"doc_id": F.col("doc_id") + offset, "slot": F.col("slot") + offset}))
        words.append(_shifted(t.bits, offset))
        offset += t.meta.num_docs
    bits = words[0]
    for w in words[1:]:
        bits = bits.unionByName(w)
    if any(t.meta.num_docs % WORD for t in tables[:-1]):  # words at the seams have bits of two indices
        bits = bits.groupBy("page_id", "row_idx", "word_idx").agg(F.bit_or("bits").alias("bits"))
    every = docs[0]
    for d in docs[1:]:
        every = every.unionByName(d)
    m = tables[0].meta
    pages = spark.createDataFrame([(0, sizes[0][0].signature_size)], "page_id int, signature_size bigint")
    return Tables(Meta("classic", m.term_size, m.canonicalize, m.num_hashes, m.family, offset, offset), pages, every, bits, parts=tuple(parts) if all(t.source or t.parts for t in tables) else ())


def _shifted(bits: DataFrame, offset: int) -> DataFrame:
    """Bits whose slots are moved up by offset: a word is split between two where it straddles them."""
    words, within = divmod(offset, WORD)
    at = (F.col("word_idx") + words).cast("int")
    if not within:
        return bits.withColumn("word_idx", at)
    low = bits.select("page_id", "row_idx", at.alias("word_idx"), F.shiftleft("bits", within).alias("bits"))
    high = bits.select("page_id", "row_idx", (at + 1).alias("word_idx"), F.shiftrightunsigned("bits", WORD - within).alias("bits"))
    return low.unionByName(high).where("bits <> 0")


def combine_compact(tables: list[Tables], page_size: int = 8192) -> Tables:
    """Classic indices as the pages of a compact one; all but the last must be exactly 8 * page_size documents wide."""
    _same(tables, "term_size", "canonicalize", "num_hashes", "family")
    width = 8 * page_size
    for t in tables[:-1]:
        if t.meta.num_docs != width:
            raise ValueError(f"an index of {t.meta.num_docs} documents is no page of {width}")
    if tables[-1].meta.num_docs > width:
        raise ValueError("the last index is wider than a page")
    pages, docs, bits = [], [], []
    for p, t in enumerate(tables):
        page = F.lit(p).alias("page_id")
        pages.append(t.pages.withColumn("page_id", page))
        docs.append(t.docs.withColumns({"page_id": page, "doc_id": F.lit(p).cast("bigint") * width + F.col("slot")}))
        bits.append(t.bits.withColumn("page_id", page))

    def union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    m = tables[0].meta
    return Tables(Meta("compact", m.term_size, m.canonicalize, m.num_hashes, m.family, sum(t.meta.num_docs for t in tables), width), union(pages), union(docs), union(bits))


def ones(tables: Tables) -> DataFrame:
    """page_id, ones, ratio: set bits of each page and their share of rows x documents."""
    width = tables.docs.groupBy("page_id").agg(F.count("*").alias("n"))
    found = scan.page_ones(tables.source) if tables.source else tables.bits.groupBy("page_id").agg(F.sum(F.bit_count("bits")).cast("bigint").alias("ones"))
    return tables.pages.join(width, "page_id").join(found, "page_id", "left").select("page_id", F.coalesce("ones", F.lit(0).cast("bigint")).alias("ones"), (F.coalesce("ones", F.lit(0)) / (F.col("signature_size") * F.col("n"))).alias("ratio"))


def row_ones(tables: Tables) -> DataFrame:
    """row_idx, ones: set bits of each row of a classic index that has one."""
    if tables.source:
        return scan.row_ones(tables.source)
    return tables.bits.groupBy("row_idx").agg(F.sum(F.bit_count("bits")).cast("bigint").alias("ones"))

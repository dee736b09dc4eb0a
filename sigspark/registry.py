"""Queries of the engine and their SQL twins, by name."""

from __future__ import annotations

import gzip
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.functions import sizing
from sigspark.functions.hashing import term_row
from sigspark.functions.terms import base_name, canonical_windows, packed, windows
from sigspark.model import ClassicParams, CompactParams
from sigspark.operators import build, counting, listing, search, workload
from sigspark.plans import index
from sigspark.plans.storage import materialize, new_path
from sigspark.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
K = 31
MD5 = {"canonicalize": False, "family": "md5_60"}


def registered(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """Few files hold all of a small table: its rows go to all cores before they become terms. A table of many files is read by all cores as it is."""
    spark = df.sparkSession
    if len(df.inputFiles()) >= spark.sparkContext.defaultParallelism:
        return df
    return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    return files.from_table(_spread(_table(spark, sf, "documents").select("doc_id", "text")), "doc_id", "text")


def _urls(spark: SparkSession, sf: str) -> DataFrame:
    return files.from_table(_table(spark, sf, "pages"), "page_id", "url")


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _ids(spark: SparkSession, sf: str) -> DataFrame:
    return _corpus(spark, sf).select(F.col("name").cast("bigint").alias("doc_id"), "name", "seq")


def _unspread(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("seq"))


def _results(found: DataFrame) -> DataFrame:
    return found.select("query_id", "index_no", F.col("doc_name"), "score", "rank")


# ---- listing

_DOCS = f"d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS name, lpad(CAST(doc_id AS VARCHAR), 20, '0') AS path, octet_length(encode(coalesce(text, ''))) AS size, greatest(octet_length(encode(coalesce(text, ''))) - {K - 1}, 0) AS num_terms FROM documents)"


@registered(f"WITH {_DOCS} SELECT row_number() OVER (ORDER BY path) - 1 AS doc_no, name, size, num_terms FROM d")
def doc_list(spark: SparkSession, sf: str) -> DataFrame:
    return listing.listed(_corpus(spark, sf), K).select(F.col("doc_id").alias("doc_no"), "name", "size", "num_terms")


@registered(f"WITH {_DOCS} SELECT count(*) AS count, min(num_terms) AS min, max(num_terms) AS max, CAST(floor(avg(num_terms)) AS BIGINT) AS avg, CAST(sum(num_terms) AS BIGINT) AS total FROM d")
def doc_list_summary(spark: SparkSession, sf: str) -> DataFrame:
    return listing.summary(files.documents(_corpus(spark, sf), K))


@registered(f"WITH {_DOCS} SELECT row_number() OVER (ORDER BY size, path) - 1 AS doc_no, name, size FROM d")
def doc_sort_by_size(spark: SparkSession, sf: str) -> DataFrame:
    return listing.listed(_corpus(spark, sf), K, "size").select(F.col("doc_id").alias("doc_no"), "name", "size")


@registered(
    f"WITH {_DOCS}, n AS (SELECT *, row_number() OVER (ORDER BY path) - 1 AS doc_no FROM d), b AS (SELECT *, doc_no // 64 AS batch FROM n) "
    "SELECT doc_no, name, batch, lpad(CAST(batch AS VARCHAR), 6, '0') || '_[' || first_value(name) OVER w || '-' || last_value(name) OVER w || ']' AS batch_name "
    "FROM b WINDOW w AS (PARTITION BY batch ORDER BY doc_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
)
def doc_batches(spark: SparkSession, sf: str) -> DataFrame:
    return listing.batches(listing.listed(_corpus(spark, sf), K), 64).select(F.col("doc_id").alias("doc_no"), "name", "batch", "batch_name")


# ---- names and types

_ENDS = [".txt", ".ctx", ".cortex", ".km_doc", ".fa", ".fasta.gz", ".fna", ".fq", ".fastq.gz", ".mfasta", ".mfastq", ".list", ".csv", ".v2.fasta"]
_PATH = "'/data/d' || (p_partkey % 7) || '/s' || p_partkey || [" + ", ".join(f"'{e}'" for e in _ENDS) + f"][p_partkey % {len(_ENDS)} + 1]"


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    end = F.get(F.array(*map(F.lit, _ENDS)), (F.col("p_partkey") % len(_ENDS)).cast("int"))
    return _table(spark, sf, "part").select("p_partkey", F.concat(F.lit("/data/d"), (F.col("p_partkey") % 7).cast("string"), F.lit("/s"), F.col("p_partkey").cast("string"), end).alias("path"))


@registered(
    f"WITH p AS (SELECT p_partkey, {_PATH} AS path FROM part), t AS (SELECT p_partkey, path, CASE WHEN path LIKE '%.txt' THEN 'text' WHEN path LIKE '%.ctx' OR path LIKE '%.cortex' THEN 'cortex' "
    "WHEN regexp_matches(path, '\\.[a-z]+_doc$') THEN 'kmers' WHEN path LIKE '%.mfasta' THEN 'mfasta' WHEN path LIKE '%.mfastq' THEN 'mfastq' WHEN regexp_matches(path, '\\.(fa|fasta|fna|ffn|faa|frn)(\\.gz)?$') THEN 'fasta' "
    "WHEN regexp_matches(path, '\\.(fq|fastq)(\\.gz)?$') THEN 'fastq' WHEN path LIKE '%.list' THEN 'list' ELSE 'any' END AS file_type FROM p) "
    "SELECT p_partkey, path, file_type, file_type NOT IN ('list', 'any') AS accepted FROM t"
)
def type_sniff(spark: SparkSession, sf: str) -> DataFrame:
    typed = _paths(spark, sf).withColumn("file_type", files.sniff(F.col("path")))
    return typed.withColumn("accepted", files.accepted(F.col("file_type")))


@registered(f"WITH p AS (SELECT p_partkey, {_PATH} AS path FROM part) SELECT p_partkey, regexp_extract(path, '([^/.]*)[^/]*$', 1) AS name FROM p")
def base_names(spark: SparkSession, sf: str) -> DataFrame:
    return _paths(spark, sf).select("p_partkey", base_name(F.col("path")).alias("name"))


_LINE = "CASE turn % 5 WHEN 0 THEN '' WHEN 1 THEN '# ' || role WHEN 2 THEN '/abs/' || conv_id ELSE 'rel/' || conv_id || '.txt' END"


@registered(f"WITH l AS (SELECT {_LINE} AS v FROM conversations) SELECT CASE WHEN v LIKE '/%' THEN v ELSE '/lists/' || v END AS path FROM l WHERE trim(v) <> '' AND v NOT LIKE '#%'")
def list_file(spark: SparkSession, sf: str) -> DataFrame:
    return files.list_paths(_table(spark, sf, "conversations").select(F.expr(_LINE).alias("value")), "/lists")


# ---- terms

_TERMS = f"""s AS (SELECT doc_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, substr(h, 2 * i - 1, {2 * K}) AS term FROM (SELECT doc_id, h, unnest(range(1, n - {K - 1} + 1)) AS i FROM s WHERE n >= {K})),
qs AS (SELECT item_id AS query_id, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM benchmark),
q AS (SELECT query_id, i - 1 AS pos, substr(h, 2 * i - 1, {2 * K}) AS term FROM (SELECT query_id, h, unnest(range(1, n - {K - 1} + 1)) AS i FROM qs WHERE n >= {K}))"""


@registered("SELECT p_partkey, i - 1 AS pos, substr(p_name, i, 5) AS term FROM (SELECT p_partkey, p_name, unnest(range(1, length(p_name) - 3)) AS i FROM part WHERE length(p_name) >= 5)")
def qgram_dump(spark: SparkSession, sf: str) -> DataFrame:
    seqs = _table(spark, sf, "part").select("p_partkey", F.col("p_name").cast("binary").alias("seq"))
    return windows(seqs, 5).withColumn("term", F.col("term").cast("string"))


@registered(f"WITH {_TERMS} SELECT doc_id, count(*) AS terms, count(DISTINCT term) AS distinct_terms FROM t GROUP BY doc_id")
def qgram_distinct_counts(spark: SparkSession, sf: str) -> DataFrame:
    return counting.distinct_counts(_unspread(spark, sf), "doc_id", K)


@registered(f"WITH {_TERMS}, f AS (SELECT term, count(DISTINCT doc_id) AS docs FROM t GROUP BY term) SELECT docs, count(*) AS terms FROM f GROUP BY docs")
def qgram_doc_freq(spark: SparkSession, sf: str) -> DataFrame:
    return counting.document_frequencies(_unspread(spark, sf), "doc_id", K)


_FROM = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ ,."
_TO = ("ACGT" * len(_FROM))[: len(_FROM)]


def _dna(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, _FROM, _TO), "[^ACGT]", "X")


_DNA = f"""n AS (SELECT doc_id, regexp_replace(translate(text, '{_FROM}', '{_TO}'), '[^ACGT]', '!', 'g') AS f FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, f, reverse(translate(f, 'ACGT', 'TGCA')) AS r, length(f) AS n FROM n),
w AS (SELECT doc_id, substr(f, i, {K}) AS f, substr(r, n - {K} - i + 2, {K}) AS r FROM (SELECT doc_id, f, r, n, unnest(range(1, n - {K - 1} + 1)) AS i FROM b WHERE n >= {K})),
c AS (SELECT doc_id, substr(r, 1, {K // 2}) < substr(f, 1, {K // 2}) AS flipped, CASE WHEN substr(r, 1, {K // 2}) < substr(f, 1, {K // 2}) THEN r ELSE f END AS term FROM w)"""


@registered(f"WITH {_DNA} SELECT doc_id, count(*) AS terms, count(*) FILTER (flipped) AS flipped, count(*) FILTER (NOT contains(term, '!')) AS valid, count(DISTINCT term) AS distinct_terms FROM c GROUP BY doc_id")
def canonical_kmers(spark: SparkSession, sf: str) -> DataFrame:
    seqs = _table(spark, sf, "documents").select("doc_id", _dna(F.col("text")).cast("binary").alias("seq"))
    return counting.distinct_counts(seqs, "doc_id", K, canonicalize=True).select("doc_id", "terms", "flipped", "valid", "distinct_terms")


@registered("SELECT octet_length(encode(text)) AS length, count(*) AS n FROM conversations WHERE text IS NOT NULL GROUP BY 1")
def length_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return listing.length_histogram(_table(spark, sf, "conversations").select(F.col("text").cast("binary").alias("seq")))


# ---- sizes


@registered("SELECT r_regionkey, round(-(r_regionkey + 1) / ln(1 - pow(0.3::DOUBLE, 1.0::DOUBLE / (r_regionkey + 1))), 9) AS low, round(-(r_regionkey + 1) / ln(1 - pow(0.1::DOUBLE, 1.0::DOUBLE / (r_regionkey + 1))), 9) AS high FROM region")
def signature_ratio(spark: SparkSession, sf: str) -> DataFrame:
    h = F.col("r_regionkey") + 1
    return _table(spark, sf, "region").select("r_regionkey", *(F.round(sizing.size_ratio_col(h, F.lit(rate)), 9).alias(name) for name, rate in (("low", 0.3), ("high", 0.1))))


@registered(f"WITH {_DOCS} SELECT name, " + ", ".join(f"CAST(ceil(num_terms * (-{h} / ln(1 - pow(0.3::DOUBLE, 1.0::DOUBLE / {h})))) AS BIGINT) AS h{h}" for h in (1, 2, 3)) + " FROM d")
def signature_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return files.documents(_corpus(spark, sf), K).select("name", *(sizing.signature_size_col(F.col("num_terms"), h, 0.3).alias(f"h{h}") for h in (1, 2, 3)))


_R1 = "(-1 / ln(1 - 0.3::DOUBLE))"
_CLASSIC = f"{_DOCS}, z AS (SELECT greatest(1, CAST(ceil(max_by(num_terms, (size, path)) * {_R1}) AS BIGINT)) AS m FROM d)"


@registered(f"WITH {_CLASSIC} SELECT m AS signature_size FROM z")
def classic_signature_size(spark: SparkSession, sf: str) -> DataFrame:
    size = build.classic_size(files.documents(_corpus(spark, sf), K), ClassicParams())
    return spark.createDataFrame([(size,)], "signature_size bigint")


_PAGE = 8 * 2
_PAGED = f"""{_DOCS}, g AS (SELECT *, (row_number() OVER (ORDER BY size, path) - 1) // {_PAGE} AS page_id FROM d),
l AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY path) - 1 AS slot FROM g),
z AS (SELECT page_id, greatest(1, CAST(ceil(max(num_terms) * {_R1}) AS BIGINT)) AS m FROM l GROUP BY page_id)"""


@registered(f"WITH {_PAGED} SELECT name, CAST(page_id AS INTEGER) AS page_id, slot FROM l")
def compact_pages(spark: SparkSession, sf: str) -> DataFrame:
    return build.paged(files.documents(_corpus(spark, sf), K), _PAGE).select("name", "page_id", "slot")


@registered(f"WITH {_PAGED} SELECT CAST(page_id AS INTEGER) AS page_id, m AS signature_size FROM z")
def page_signature_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return build.page_sizes(build.paged(files.documents(_corpus(spark, sf), K), _PAGE), CompactParams())


# ---- index contents


def _md5(term: str, j: str, m: str) -> str:
    return f"(('0x' || substr(md5('{j}:'::BLOB || unhex({term})), 1, 15))::BIGINT % {m})"


@registered(f"SELECT p_partkey, j, ('0x' || substr(md5(j || ':' || p_name), 1, 15))::BIGINT % 1000003 AS row_idx FROM part, (SELECT unnest([0, 1, 2]) AS j)")
def term_hash_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = F.array(*[term_row(F.col("p_name").cast("binary"), j, F.lit(1000003), "md5_60") for j in range(3)])
    return _table(spark, sf, "part").select("p_partkey", F.posexplode(rows).alias("j", "row_idx"))


@registered(
    "WITH u AS (SELECT row_number() OVER (ORDER BY lpad(CAST(page_id AS VARCHAR), 20, '0')) - 1 AS slot, url FROM pages), "
    "t AS (SELECT slot, substr(url, i, 11) AS term FROM (SELECT slot, url, unnest(range(1, length(url) - 9)) AS i FROM u WHERE length(url) >= 11)), "
    "p AS (SELECT DISTINCT ('0x' || substr(md5('0:' || term), 1, 15))::BIGINT % 4096 AS row_idx, slot FROM t) "
    "SELECT row_idx, CAST(slot // 64 AS INTEGER) AS word_idx, bit_or(CASE WHEN slot % 64 = 63 THEN -9223372036854775808 ELSE 1::BIGINT << (slot % 64) END) AS bits FROM p GROUP BY 1, 2"
)
def classic_bits(spark: SparkSession, sf: str) -> DataFrame:
    return build.build_classic(_urls(spark, sf), ClassicParams(term_size=11, signature_size=4096, **MD5)).bits.select("row_idx", "word_idx", "bits")


@registered(f"WITH {_TERMS}, {_CLASSIC}, p AS (SELECT DISTINCT doc_id, {_md5('term', '0', 'm')} AS row_idx FROM t, z) SELECT row_idx, count(*) AS ones FROM p GROUP BY row_idx")
def row_popcount(spark: SparkSession, sf: str) -> DataFrame:
    return build.row_ones(build.build_classic(_corpus(spark, sf), ClassicParams(**MD5)))


@registered(
    f"WITH {_TERMS}, {_PAGED}, p AS (SELECT DISTINCT l.page_id, l.slot, {_md5('term', '0', 'm')} AS row_idx FROM t JOIN l USING (doc_id) JOIN z ON z.page_id = l.page_id), "
    "o AS (SELECT page_id, count(*) AS ones FROM p GROUP BY page_id), n AS (SELECT page_id, count(*) AS n FROM l GROUP BY page_id) "
    "SELECT CAST(z.page_id AS INTEGER) AS page_id, coalesce(ones, 0) AS ones, round(coalesce(ones, 0)::DOUBLE / (m * n), 9) AS ratio FROM z JOIN n USING (page_id) LEFT JOIN o USING (page_id)"
)
def ones_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return build.ones(build.build_compact(_corpus(spark, sf), CompactParams(page_size=2, **MD5))).withColumn("ratio", F.round("ratio", 9))


# ---- search


def _ranked(scored: str, threshold: float, limit: int = 0, every: bool = False) -> str:
    """SQL over c(query_id, index_no, doc_id, doc_name, score): threshold, rank, limit."""
    need = f"need AS (SELECT query_id, CAST(ceil({threshold}::DOUBLE * greatest(n - {K - 1}, 0)) AS BIGINT) AS need FROM qs)"
    out = f"{need}, {scored}, k AS (SELECT c.* FROM c JOIN need USING (query_id) WHERE score >= need), o AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, index_no, doc_id) AS INTEGER) AS rank FROM k) SELECT query_id, index_no, doc_name, score, rank FROM o"
    return out + (f" WHERE rank <= {limit}" if limit else "")


_EXACT = "x AS (SELECT DISTINCT doc_id, term FROM t SEMI JOIN q USING (term)), c AS (SELECT query_id, 0 AS index_no, doc_id, CAST(doc_id AS VARCHAR) AS doc_name, count(*) AS score FROM q JOIN x USING (term) GROUP BY query_id, doc_id)"
_EVERY = _EXACT.replace("c AS", "e AS") + ", c AS (SELECT qs.query_id, 0 AS index_no, documents.doc_id, CAST(documents.doc_id AS VARCHAR) AS doc_name, coalesce(score, 0) AS score FROM qs CROSS JOIN documents LEFT JOIN e ON e.query_id = qs.query_id AND e.doc_id = documents.doc_id)"


@registered(f"WITH {_TERMS}, {_EXACT} SELECT query_id, doc_id, score FROM c")
def search_exact(spark: SparkSession, sf: str) -> DataFrame:
    return search.exact_scores(_asked(spark, sf), _ids(spark, sf), K)


@registered(f"WITH {_TERMS}, {_ranked(_EXACT, 0.8)}")
def search_exact_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return _results(search.exact_search(_asked(spark, sf), _ids(spark, sf), K, threshold=0.8))


@registered(f"WITH {_TERMS}, {_ranked(_EVERY, 0.0, 3)}")
def search_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _results(search.exact_search(_asked(spark, sf), _ids(spark, sf), K, limit=3))


@registered(f"WITH {_TERMS}, {_ranked(_EVERY, 0.0)}")
def search_zero_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return _results(search.exact_search(_asked(spark, sf), _ids(spark, sf), K))


def _index(h: int, ratio: str) -> str:
    """SQL for a classic index of the documents: c as in _ranked()."""
    p = " UNION ALL ".join(f"SELECT DISTINCT doc_id, {j} AS j, {_md5('term', str(j), 'm')} AS row_idx FROM t, z" for j in range(h))
    r = " UNION ALL ".join(f"SELECT query_id, pos, {j} AS j, {_md5('term', str(j), 'm')} AS row_idx FROM q, z" for j in range(h))
    return (
        f"{_CLASSIC.replace(_R1, ratio)}, p AS ({p}), pr AS (SELECT DISTINCT doc_id, row_idx FROM p), r AS ({r}), "
        f"hit AS (SELECT query_id, pos, doc_id FROM r JOIN pr USING (row_idx) GROUP BY query_id, pos, doc_id HAVING count(DISTINCT j) = {h}), "
        "c AS (SELECT query_id, 0 AS index_no, doc_id, CAST(doc_id AS VARCHAR) AS doc_name, count(*) AS score FROM hit GROUP BY query_id, doc_id)"
    )


_R3 = "(-3 / ln(1 - pow(0.1::DOUBLE, 1.0::DOUBLE / 3)))"
_COMPACT = f"""{_PAGED}, p AS (SELECT DISTINCT l.doc_id, l.page_id, l.slot, {_md5('term', '0', 'm')} AS row_idx FROM t JOIN l USING (doc_id) JOIN z ON z.page_id = l.page_id),
r AS (SELECT query_id, pos, page_id, {_md5('term', '0', 'm')} AS row_idx FROM q, z),
c AS (SELECT query_id, 0 AS index_no, page_id * {_PAGE} + slot AS doc_id, CAST(p.doc_id AS VARCHAR) AS doc_name, count(*) AS score FROM r JOIN p USING (page_id, row_idx) GROUP BY query_id, page_id, slot, p.doc_id)"""


def _classic(spark: SparkSession, sf: str, **more) -> build.Tables:
    return build.build_classic(_corpus(spark, sf), ClassicParams(**MD5, **more))


@registered(f"WITH {_TERMS}, {_ranked(_index(1, _R1), 0.8)}")
def search_classic(spark: SparkSession, sf: str) -> DataFrame:
    return _results(search.search(_asked(spark, sf), [_classic(spark, sf)], 0.8))


@registered(f"WITH {_TERMS}, {_ranked(_index(3, _R3), 0.5)}")
def search_multihash(spark: SparkSession, sf: str) -> DataFrame:
    return _results(search.search(_asked(spark, sf), [_classic(spark, sf, num_hashes=3, false_positive_rate=0.1)], 0.5))


@registered(f"WITH {_TERMS}, {_ranked(_COMPACT, 0.8)}")
def search_compact(spark: SparkSession, sf: str) -> DataFrame:
    tables = build.build_compact(_corpus(spark, sf), CompactParams(page_size=2, **MD5))
    return _results(search.search(_asked(spark, sf), [tables], 0.8))


@registered(f"WITH {_TERMS}, {_ranked(_index(1, _R1), 0.3, 5)}")
def search_limit(spark: SparkSession, sf: str) -> DataFrame:
    return _results(search.search(_asked(spark, sf), [_classic(spark, sf)], 0.3, 5))


def _of(k: int, at: int, size: int, where: str) -> str:
    """SQL for index number `at`, of the documents where it says so: need<at> and c<at> as in _ranked()."""
    t = _TERMS.replace("s AS (", f"s{at} AS (").replace("t AS (", f"t{at} AS (").replace("q AS (", f"q{at} AS (").replace("qs AS (", f"qs{at} AS (").replace("FROM s ", f"FROM s{at} ").replace("FROM qs ", f"FROM qs{at} ")
    t = t.replace(f"qs{at}{at}", f"qs{at}").replace("WHERE text IS NOT NULL", f"WHERE text IS NOT NULL AND {where}")
    t = t.replace(f"2 * i - 1, {2 * K}", f"2 * i - 1, {2 * k}").replace(f"n - {K - 1} + 1", f"n - {k - 1} + 1").replace(f"n >= {K}", f"n >= {k}")
    return (
        f"{t}, need{at} AS (SELECT query_id, CAST(ceil(0.8::DOUBLE * greatest(n - {k - 1}, 0)) AS BIGINT) AS need FROM qs{at}), "
        f"p{at} AS (SELECT DISTINCT doc_id, {_md5('term', '0', str(size))} AS row_idx FROM t{at}), r{at} AS (SELECT query_id, pos, {_md5('term', '0', str(size))} AS row_idx FROM q{at}), "
        f"c{at} AS (SELECT query_id, {at} AS index_no, doc_id, CAST(doc_id AS VARCHAR) AS doc_name, count(*) AS score FROM r{at} JOIN p{at} USING (row_idx) JOIN need{at} USING (query_id) GROUP BY query_id, doc_id, need HAVING count(*) >= need)"
    )


_SETS = [(31, 60000, "doc_id % 4 = 0"), (24, 50000, "doc_id % 4 = 1"), (31, 40009, "doc_id % 4 > 1")]


@registered(
    "WITH " + ", ".join(_of(k, at, size, where) for at, (k, size, where) in enumerate(_SETS)) + ", c AS (" + " UNION ALL ".join(f"SELECT * FROM c{at}" for at in range(len(_SETS)))
    + ") SELECT query_id, index_no, doc_name, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, index_no, doc_id) AS INTEGER) AS rank FROM c"
)
def search_multi_index(spark: SparkSession, sf: str) -> DataFrame:
    """Three indices of different documents, term sizes and signature sizes."""
    every = _corpus(spark, sf).withColumn("doc_id", F.col("name").cast("bigint"))
    tables = [build.build_classic(every.where(where).drop("doc_id"), ClassicParams(term_size=k, signature_size=size, **MD5)) for k, size, where in _SETS]
    return _results(search.search(_asked(spark, sf), tables, 0.8))


@registered()
def search_xxh64(spark: SparkSession, sf: str) -> DataFrame:
    """search_classic with the default hash family, which SQL engines don't share."""
    return _results(search.search(_asked(spark, sf), [build.build_classic(_corpus(spark, sf), ClassicParams(canonicalize=False))], 0.8))


def _halves(spark: SparkSession, sf: str, size: int) -> list[build.Tables]:
    every = _corpus(spark, sf).withColumn("odd", F.col("name").cast("bigint") % 2)
    return [build.build_classic(every.where(F.col("odd") == i).drop("odd"), ClassicParams(signature_size=size, **MD5)) for i in (0, 1)]


def _fixed(size: int) -> str:
    return _index(1, _R1).replace(f"{_CLASSIC}", f"{_DOCS}, z AS (SELECT {size} AS m)")


@registered(f"WITH {_TERMS}, {_ranked(_fixed(60000).replace('SELECT query_id, 0 AS index_no, doc_id, CAST', 'SELECT query_id, 0 AS index_no, (doc_id % 2) * 1000000000000 + doc_id AS doc_id, CAST'), 0.8)}")
def combine_classic(spark: SparkSession, sf: str) -> DataFrame:
    return _results(search.search(_asked(spark, sf), [build.combine_classic(_halves(spark, sf, 60000))], 0.8))


@registered(f"WITH {_TERMS}, {_ranked(_fixed(60000), 0.8)}")
def combine_compact(spark: SparkSession, sf: str) -> DataFrame:
    """Four indices, of which all but the last are exactly a page wide, stored, combined and opened again."""
    corpus = _corpus(spark, sf)
    docs = listing.listed(corpus, K)
    page_size = -(-docs.count() // 32)
    paths = []
    for i in range(4):
        own = docs.where(F.floor(F.col("doc_id") / (8 * page_size)) == i).select("path")
        paths.append(f"{new_path(spark)}/{i}")
        index.construct_classic(spark, corpus.join(own, "path", "left_semi"), paths[-1], ClassicParams(signature_size=60000, **MD5))
    tables = build.combine_compact([index.read(spark, p) for p in paths], page_size)
    index.write(tables, joined := new_path(spark))
    return _results(search.search(_asked(spark, sf), [index.read(spark, joined)], 0.8))


@registered("SELECT 0::BIGINT AS violations")
def no_false_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs whose exact score is above the index's, over one and three hashes and both layouts."""
    asked, corpus = _asked(spark, sf), _corpus(spark, sf)
    exact = materialize(search.exact_scores(asked, corpus, K, key="path").withColumnRenamed("score", "least"))
    paths = exact.select("path").distinct()  # a document without an exact score is no violation
    bad = None
    for tables in (_classic(spark, sf), _classic(spark, sf, num_hashes=3), build.build_compact(corpus, CompactParams(canonicalize=False, page_size=2, num_hashes=2))):
        found = search.found_in(asked, tables.only(paths), 1e-9).join(tables.docs.select("doc_id", "path"), "doc_id").select("query_id", "path", "score")
        missed = exact.join(found, ["query_id", "path"], "left").where(F.coalesce("score", F.lit(0)) < F.col("least"))
        bad = missed if bad is None else bad.unionByName(missed)
    return bad.agg(F.count("*").alias("violations"))


@registered(f"WITH {_TERMS}, {_index(1, _R1)}, h AS (SELECT score, count(*) AS pairs FROM c GROUP BY score UNION ALL SELECT 0, (SELECT count(*) FROM qs) * (SELECT count(*) FROM documents) - (SELECT count(*) FROM c)) SELECT score, CAST(sum(pairs) AS BIGINT) AS pairs FROM h GROUP BY score HAVING sum(pairs) > 0")
def fpr_histogram(spark: SparkSession, sf: str) -> DataFrame:
    tables, asked = _classic(spark, sf), _asked(spark, sf)
    return workload.histogram(asked, tables)


# ---- workloads

_TURNS = f"ts AS (SELECT conv_id, turn, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM conversations WHERE text IS NOT NULL), tt AS (SELECT conv_id, turn, substr(h, 2 * i - 1, {2 * K}) AS term FROM (SELECT conv_id, turn, h, unnest(range(1, n - {K - 1} + 1)) AS i FROM ts WHERE n >= {K}))"


@registered(f"WITH {_TERMS}, {_TURNS}, bad AS (SELECT DISTINCT conv_id * 1000 + turn AS query_id FROM tt SEMI JOIN t USING (term)) SELECT DISTINCT conv_id * 1000 + turn AS query_id FROM conversations ANTI JOIN bad ON bad.query_id = conversations.conv_id * 1000 + conversations.turn")
def true_negatives(spark: SparkSession, sf: str) -> DataFrame:
    asked = _table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))
    return workload.true_negatives(asked, _ids(spark, sf), K).select("query_id").distinct()


@registered()
def generated_queries(spark: SparkSession, sf: str) -> DataFrame:
    return workload.generate_queries(_corpus(spark, sf), 200, 200, K, 50, only_true=True, seed=7)


@registered()
def random_index(spark: SparkSession, sf: str) -> DataFrame:
    return build.ones(workload.random_index(spark, 100, 2000, 6000, ClassicParams(num_hashes=2), seed=1))


# ---- parsers, on files made of columns


def _made(spark: SparkSession, sf: str, kind: str, content: Column, where: str = "true") -> DataFrame:
    key = F.col("p_partkey").cast("string")
    made = _spread(_table(spark, sf, "part")).where(where).select(key.alias("path"), F.lit(kind).alias("file_type"), key.alias("name"), F.octet_length(content).cast("bigint").alias("size"), content.cast("binary").alias("content"))
    return files.decoded(made).select("name", "subdoc_index", F.col("seq").cast("string").alias("seq"))


@registered("SELECT CAST(p_partkey AS VARCHAR) AS name, 0 AS subdoc_index, unnest([p_type || p_brand, p_name]) AS seq FROM part")
def fasta_sequences(spark: SparkSession, sf: str) -> DataFrame:
    lines = [F.concat(F.lit(">"), "p_brand"), F.col("p_type"), F.col("p_brand"), F.lit(""), F.lit(";note"), F.col("p_name"), F.lit("")]
    return _made(spark, sf, "fasta", F.concat_ws("\n", *lines))


@registered("SELECT CAST(p_partkey AS VARCHAR) AS name, 0 AS subdoc_index, unnest([p_type, p_name]) AS seq FROM part")
def fastq_reads(spark: SparkSession, sf: str) -> DataFrame:
    lines = [F.lit("@a"), F.col("p_type"), F.lit("+"), F.col("p_type"), F.lit("@b"), F.col("p_name"), F.lit("+b"), F.col("p_name"), F.lit("")]
    return _made(spark, sf, "fastq", F.concat_ws("\n", *lines))


@registered("SELECT p_partkey || '_' || lpad(CAST(i AS VARCHAR), 6, '0') AS name, CAST(i AS INTEGER) AS subdoc_index, [p_type || p_brand, p_name, ''][i + 1] AS seq FROM part, (SELECT unnest([0, 1, 2]) AS i)")
def mfasta_subdocs(spark: SparkSession, sf: str) -> DataFrame:
    lines = [F.lit(">a"), F.col("p_type"), F.col("p_brand"), F.lit(">b"), F.col("p_name"), F.lit(";c"), F.col("p_type"), F.lit(">d"), F.lit("")]
    return _made(spark, sf, "mfasta", F.concat_ws("\n", *lines))


@registered("SELECT p_partkey || '_' || lpad(CAST(i AS VARCHAR), 6, '0') AS name, CAST(i AS INTEGER) AS subdoc_index, [p_type, p_name][i + 1] AS seq FROM part, (SELECT unnest([0, 1]) AS i)")
def mfastq_reads(spark: SparkSession, sf: str) -> DataFrame:
    lines = [F.lit("@a"), F.col("p_type"), F.lit("+"), F.col("p_type"), F.lit("@b"), F.col("p_name"), F.lit("+b"), F.col("p_name"), F.lit("")]
    return _made(spark, sf, "mfastq", F.concat_ws("\n", *lines))


def _packed(kind: str) -> Column:
    """Graph files and packed documents of two 7-mers: the digits of p_partkey and p_size as letters."""
    mers = [F.translate(F.lpad(F.conv(c, 10, 4), 7, "0"), "0123", "ACGT").cast("binary") for c in ("p_partkey", "p_size")]
    two = [packed(m, 7) for m in mers]
    number = lambda n: F.lit(n.to_bytes(4, "little"))
    if kind == "cortex":
        name, zeros = F.col("p_brand").cast("binary"), lambda n: F.lit(bytes(n))
        size = F.concat(F.to_binary(F.lpad(F.hex(F.length("p_brand")), 2, "0"), F.lit("hex")), zeros(3))
        bodies = [F.concat(t, zeros(6), zeros(5)) for t in two]
        return F.concat(F.lit(b"CORTEX"), number(6), number(7), number(1), number(1), zeros(12), size, name, zeros(16), zeros(12), number(0), F.lit(b"CORTEX"), *bodies)
    return F.concat(F.lit(b"SIGSPDOCUMENT"), number(1), number(7), F.col("p_brand").cast("binary"), F.lit(b"\0DOCUMENT"), *two)


_BASE4 = "list_reduce(list_transform(range(7), lambda i: ['A', 'C', 'G', 'T'][({c} // power(4, 6 - i)::BIGINT) % 4 + 1]), lambda a, b: a || b)"
_TWO = f"SELECT p_brand AS name, 0 AS subdoc_index, unnest([{_BASE4.format(c='(p_partkey % 16384)')}, {_BASE4.format(c='p_size')}]) AS seq FROM part WHERE p_partkey < 16384"


@registered(_TWO)
def cortex_graphs(spark: SparkSession, sf: str) -> DataFrame:
    return _made(spark, sf, "cortex", _packed("cortex"), "p_partkey < 16384")


@registered(_TWO)
def packed_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _made(spark, sf, "kmers", _packed("kmers"), "p_partkey < 16384")


@registered("SELECT CAST(p_partkey AS VARCHAR) AS name, 0 AS subdoc_index, p_name AS seq FROM part")
def gzip_fasta(spark: SparkSession, sf: str) -> DataFrame:
    content = F.concat(F.lit(">"), "p_brand", F.lit("\n"), "p_name", F.lit("\n"))

    @F.pandas_udf("binary")
    def zipped(s: pd.Series) -> pd.Series:
        return s.map(lambda x: gzip.compress(x.encode()))

    return _made(spark, sf, "fasta", zipped(content))


@registered("SELECT row_number() OVER (ORDER BY item_id) - 1 AS query_id, ' item ' || item_id AS comment, regexp_replace(text, '[\r\n]', '', 'g') AS query FROM benchmark")
def query_file(spark: SparkSession, sf: str) -> DataFrame:
    """Queries written to a file and read back."""
    asked = _table(spark, sf, "benchmark").orderBy("item_id").select(F.format_string(" item %d", "item_id").alias("comment"), F.regexp_replace("text", "[\r\n]", "").alias("query"))
    files.write_queries(asked.coalesce(1), path := new_path(spark))
    return files.read_queries(spark, path).withColumn("query", F.decode("query", "UTF-8")).withColumn("comment", F.col("comment"))


@registered("SELECT p_partkey, least(4096, greatest(8, CASE WHEN r <= 1 THEN 1 ELSE power(2, ceil(log2(r))) END))::BIGINT AS page_size FROM (SELECT p_partkey, floor(sqrt((p_partkey * p_size * 97) // 8)) AS r FROM part)")
def page_size_default(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "part").select("p_partkey", sizing.page_size_col(F.col("p_partkey") * F.col("p_size") * 97).alias("page_size"))


@registered("SELECT p_partkey, " + ", ".join(f"round(1 - power(1 - 1.0::DOUBLE / m, m * {h} / (-{h} / ln(1 - power(0.3::DOUBLE, 1.0::DOUBLE / {h})))), 9) AS h{h}" for h in (1, 2, 3)) + " FROM (SELECT p_partkey, (p_partkey + 1) * 1000 AS m FROM part)")
def set_bit_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "part").select("p_partkey", *(F.round(sizing.set_bit_ratio_col((F.col("p_partkey") + 1) * 1000, h, 0.3), 9).alias(f"h{h}") for h in (1, 2, 3)))


@registered(
    "WITH u AS (SELECT lpad(CAST(p_partkey AS VARCHAR), 20, '0') AS path, CAST(p_partkey AS VARCHAR) AS name, p_name FROM part), "
    "t AS (SELECT path, name, i - 1 AS pos, substr(p_name, i, 11) AS term, md5(p_name) AS part FROM (SELECT *, unnest(range(1, length(p_name) - 9)) AS i FROM u WHERE length(p_name) >= 11)) "
    "SELECT name, pos, term FROM t ORDER BY md5('5:' || path || ':0:' || part || ':' || pos), path, part, pos LIMIT 100"
)
def positive_sample(spark: SparkSession, sf: str) -> DataFrame:
    names = files.from_table(_table(spark, sf, "part"), "p_partkey", "p_name")
    return workload.sample_terms(names, 11, 100, 5, "md5").select("name", "pos", F.col("term").cast("string").alias("term"))


@registered(f"WITH {_DNA} SELECT doc_id, count(*) AS invalid FROM c WHERE contains(term, '!') GROUP BY doc_id")
def invalid_kmers(spark: SparkSession, sf: str) -> DataFrame:
    seqs = _spread(_table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", _dna(F.col("text")).cast("binary").alias("seq"))
    return canonical_windows(seqs, K).where("not valid").groupBy("doc_id").agg(F.count("*").alias("invalid"))

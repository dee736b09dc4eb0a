"""Steps that a row for each window, or a shuffle of them, made too large: counted and scored without it, and the same."""

import hashlib
import re
from collections import Counter
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest import SF
from pyspark.sql import functions as F

from sigspark import registry
from sigspark.functions import kernels
from sigspark.model import ClassicParams, CompactParams
from sigspark.operators import build, counting, search, workload
from sigspark.plans.sql import canonical
from sigspark.sources import files

RNG = np.random.default_rng(3)


def exchanged(df):
    """Shuffles by key and rows made of others."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return re.findall(r"RepartitionByExpression|Generate explode", plan)


def test_many_windows_are_taken_in_shares(monkeypatch):
    monkeypatch.setattr(kernels, "SHARE", 50)
    raw = b"a" * 400 + RNG.integers(0, 4, 300, dtype=np.uint8).tobytes() * 2
    for k in (2, 9, 31):
        every = {raw[i : i + k] for i in range(len(raw) - k + 1)}
        found = kernels.first_places(kernels.padded(raw), k, np.arange(len(raw) - k + 1))
        assert len(found) == len(every) and {raw[i : i + k] for i in found} == every


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(kernels, "mixed", lambda words: words[0] & np.uint64(1))
    raw = RNG.integers(0, 256, 200, dtype=np.uint8).tobytes() + b"x" * 40
    buf, every = kernels.padded(raw), [raw[i : i + 20] for i in range(221)]
    assert len(kernels.first_places(buf, 20, np.arange(221))) == len(set(every))
    known = kernels.Lookup(buf, 20, np.arange(0, 221, 2))
    at, number = known.find(buf, slice(0, 221))
    assert sorted(at.tolist()) == [i for i, x in enumerate(every) if x in set(every[::2])]
    assert all(every[known.places[n]] == every[a] for a, n in zip(at, number))


def test_hashes_of_batches():
    raw = RNG.integers(0, 256, 400, dtype=np.uint8).tobytes()
    buf, places = kernels.padded(raw), np.array([0, 7, 100])
    for k in (3, 8, 31, 32, 54, 55, 70):
        every = [raw[i : i + k] for i in range(len(raw) - k + 1)]
        for j in (0, 12):
            for family, plain in (("xxh64", lambda x: xxhash.xxh64_intdigest(x, seed=j)), ("md5_60", lambda x: int(hashlib.md5(b"%d:" % j + x).hexdigest()[:15], 16))):
                assert kernels.hashes(buf, k, j, family).tolist() == [plain(x) for x in every]
                assert kernels.hashes(buf, k, j, family, places).tolist() == [plain(every[i]) for i in places]


def _texts():
    words = ["ab", "abcabc", "zz zz zz", "xyxyxyxyxy", "äöü", "long" * 30]
    return [" ".join(RNG.choice(words, 20)) for _ in range(12)] + ["", "a" * 200, "abc"]


@pytest.mark.parametrize("k", [3, 5, 31])
def test_counts_of_repeated_keys(spark, k):
    """A key in two rows has the terms of both, each once; none crosses from one to the other."""
    texts = _texts()
    rows = [(i % 10, bytearray(x.encode())) for i, x in enumerate(texts)] + [(3, None)]
    df = spark.createDataFrame(rows, "key bigint, seq binary")
    own = {}
    for i, x in enumerate(texts):
        raw = x.encode()
        own.setdefault(i % 10, []).extend(raw[p : p + k] for p in range(len(raw) - k + 1))
    got = {r.key: (r.terms, r.distinct_terms) for r in counting.distinct_counts(df, "key", k).collect()}
    assert got == {i: (len(t), len(set(t))) for i, t in own.items() if t}
    docs = Counter(Counter(t for x in own.values() for t in set(x)).values())
    assert {r.docs: r.terms for r in counting.document_frequencies(df, "key", k).collect()} == docs


def test_counts_of_canonical_terms(spark):
    seqs = [RNG.choice(list(b"ACGTN"), 90).astype(np.uint8).tobytes() for _ in range(6)]
    df = spark.createDataFrame([(i % 4, bytearray(x)) for i, x in enumerate(seqs)], "key bigint, seq binary")
    own = {}
    for i, x in enumerate(seqs):
        own.setdefault(i % 4, []).extend((canonical(x[p : p + 15]), x[p : p + 15]) for p in range(len(x) - 14))
    got = {r.key: (r.terms, r.distinct_terms, r.valid) for r in counting.distinct_counts(df, "key", 15, canonicalize=True).collect()}
    assert got == {i: (len(t), len({c for (c, _), _ in t}), sum(ok for (_, ok), _ in t)) for i, t in own.items()}


@pytest.mark.parametrize("name", ["qgram_distinct_counts", "canonical_kmers", "qgram_doc_freq"])
def test_windows_are_no_rows(spark, name):
    assert "Generate explode" not in exchanged(registry.QUERIES[name](spark, SF))


@pytest.mark.parametrize("few", [0, 1 << 19])
def test_keys_that_share(spark, monkeypatch, few):
    """Few keys go to every task, many meet the corpus in a shuffle: the same result."""
    monkeypatch.setattr(counting, "FEW", few)
    asked = [("a", b"xxHELLO WORLDxx"), ("b", b"nothing here at all"), ("c", b"short"), ("a", b"other text of a"), (None, b"HELLO WORLD"), ("d", None)]
    corpus = [b"say HELLO WORLD again", b"and more of it", None, b""]
    keys = spark.createDataFrame([(k, None if x is None else bytearray(x)) for k, x in asked], "key string, seq binary")
    segments = spark.createDataFrame([(None if x is None else bytearray(x),) for x in corpus], "seq binary")
    got = {r.key for r in counting.keys_that_share(keys, segments, "key", 9).collect()}
    assert got == {"a", None}
    assert counting.keys_that_share(keys, segments.where("false"), "key", 9).count() == 0
    assert counting.keys_that_share(keys.withColumn("seq", F.col("seq")), segments, "key", 40).count() == 0


def _segments(spark, rows):
    return spark.createDataFrame([(f"p{i}", "text", f"p{i}", 0, len(x), bytearray(x)) for i, x in rows], files.SCHEMA)


def _plain(docs, queries, k, size_of, hashes, canonical_):
    """(query, path): score by sets of rows."""
    term = (lambda t: canonical(t)[0]) if canonical_ else (lambda t: t)
    rows = lambda t, m: {int(hashlib.md5(b"%d:" % j + term(t)).hexdigest()[:15], 16) % m for j in range(hashes)}
    out = {}
    for path, parts in docs.items():
        m = size_of[path]
        own = set().union(*(rows(x[i : i + k], m) for x in parts for i in range(len(x) - k + 1)), set())
        for q, text in queries.items():
            n = sum(rows(text[i : i + k], m) <= own for i in range(len(text) - k + 1))
            if n:
                out[q, path] = n
    return out


@pytest.mark.parametrize(("hashes", "canonical_", "single"), [(1, False, True), (3, True, False)])
def test_scan_of_indices_that_are_not_stored(spark, hashes, canonical_, single):
    """Classic, compact and combined, documents of one and of two segments, against sets of rows."""
    seqs = [RNG.choice(list(b"ACGT"), 60 + 20 * i).astype(np.uint8).tobytes() for i in range(20)]
    rows = [(i if single else i % 15, x) for i, x in enumerate(seqs)]
    docs = {}
    for i, x in rows:
        docs.setdefault(f"p{i}", []).append(x)
    queries = {0: seqs[3][5:50], 1: seqs[17][20:90], 2: b"ACGT" * 20}
    asked = spark.createDataFrame([(q, bytearray(x)) for q, x in queries.items()], "query_id bigint, query binary")
    own = {"canonicalize": canonical_, "num_hashes": hashes, "family": "md5_60", "term_size": 15}
    every = _segments(spark, rows)
    halves = [build.build_classic(every.where(f"path {op} 'p3'"), ClassicParams(signature_size=900, **own)) for op in ("<", ">=")]
    for tables in (build.build_classic(every, ClassicParams(**own)), build.build_compact(every, CompactParams(page_size=1, **own)), build.combine_classic(halves)):
        m = {r.page_id: r.signature_size for r in tables.pages.collect()}
        placed = tables.docs.collect()
        want = _plain(docs, queries, 15, {r.path: m[r.page_id] for r in placed}, hashes, canonical_)
        path = {r.doc_id: r.path for r in placed}
        got = {(r.query_id, path[r.doc_id]): r.score for r in search.found_in(asked, tables).collect()}
        assert got == want and len(want) > 3
        if tables.source:
            stored = replace(tables, source=None)
            assert sorted(map(tuple, build.ones(tables).collect())) == sorted(map(tuple, build.ones(stored).collect()))
            counts = {r.score: r.pairs for r in workload.histogram(asked, tables).collect()}
            assert counts == {n: c for n, c in {**Counter(want.values()), 0: 3 * len(docs) - len(want)}.items() if c}
    classic = build.build_classic(every, ClassicParams(**own))
    assert sorted(map(tuple, build.row_ones(classic).collect())) == sorted(map(tuple, build.row_ones(replace(classic, source=None)).collect()))


@pytest.mark.parametrize("name", ["search_classic", "search_multihash", "search_xxh64", "search_limit", "search_multi_index", "combine_classic", "search_compact", "fpr_histogram", "row_popcount", "ones_ratio", "search_exact", "no_false_negatives"])
def test_terms_are_no_rows(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan and "xxhash64" not in plan and "substring(seq" not in plan


@pytest.mark.parametrize("few", [0, 1 << 19])
def test_exact_scores_of_repeated_keys(spark, monkeypatch, few):
    monkeypatch.setattr(counting, "FEW", few)
    texts = [x.encode() for x in _texts()]
    asked = [(1, b"abcabc zz zz zz abcabc"), (1, b"long" * 10), (2, b"abc"), (None, b"xyxyxyxyxy ab")]
    queries = spark.createDataFrame([(i, bytearray(x)) for i, x in asked], "query_id bigint, query binary")
    segments = spark.createDataFrame([(i % 7, bytearray(x)) for i, x in enumerate(texts)], "key int, seq binary")
    own = {}
    for i, x in enumerate(texts):
        own.setdefault(i % 7, set()).update(x[p : p + 6] for p in range(len(x) - 5))
    want = Counter()
    for q, x in asked:
        for key, terms in own.items():
            want[q, key] += sum(x[p : p + 6] in terms for p in range(len(x) - 5))
    got = {(r.query_id, r.key): r.score for r in search.exact_scores(queries, segments, 6, key="key").collect()}
    assert got == {x: n for x, n in want.items() if n}


def test_small_files_are_decoded_in_batches(spark, monkeypatch):
    """Of 3,000 files in one batch, results come together; a broken one is left out or fails."""
    made = spark.range(3000, numPartitions=1).select(F.col("id").cast("string").alias("path"), F.lit("mfasta").alias("file_type"), F.col("id").cast("string").alias("name"), F.lit(9).cast("bigint").alias("size"), F.concat(F.lit(">a\nAC\n>b\nG"), F.col("id").cast("string")).cast("binary").alias("content"))
    batches = files.decoded(made).select("name", "subdoc_index", "seq")
    counted = batches.mapInArrow(lambda found: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in found), "n bigint").collect()
    assert sum(r.n for r in counted) == 6000 and len(counted) <= 3
    assert {(r.name, bytes(r.seq)) for r in batches.where("subdoc_index = 1").collect()} == {(f"{i}_000001", b"G%d" % i) for i in range(3000)}
    broken = made.limit(3).withColumn("content", F.when(F.col("path") == "1", F.lit(b"AC")).otherwise(F.col("content")))
    assert files.decoded(broken, True).count() == 4
    with pytest.raises(Exception, match="FASTA"):
        files.decoded(broken).collect()

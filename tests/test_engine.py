import gzip
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sigspark import registry
from sigspark.functions import sizing
from sigspark.functions.hashing import seed_literal, term_row
from sigspark.functions.random import random_sequence
from sigspark.functions.terms import CHUNK, canonical_windows, pack_kmers, packed, unpack_kmers, unpacked, windows
from sigspark.model import ClassicParams, CompactParams, file_type_named
from sigspark.operators import build, search, workload
from sigspark.cli import main
from sigspark.plans import index, sql
from sigspark.plans.documents import DocumentList
from sigspark.sources import files
from sigspark.streaming import search as streams


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(same, name):
    same(registry.QUERIES[name], registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    from conftest import SF

    assert registry.QUERIES[name](spark, SF).count() > 0


def test_hash_family(spark):
    raw = [bytes(np.random.default_rng(i).integers(0, 256, i + 1, dtype=np.uint8)) for i in range(40)]
    df = spark.createDataFrame([(bytearray(x),) for x in raw], "t binary")
    got = df.select(*[term_row(F.col("t"), j, F.lit(1000003)).alias(f"j{j}") for j in range(4)]).collect()
    for x, row in zip(raw, got):
        assert list(row) == [xxhash.xxh64_intdigest(x, seed=j) % 1000003 for j in range(4)]
    assert seed_literal(0) == -365884300664092260


CANONICAL = [
    (b"AGGAAAGTCTTTTACGCTGGGGTAAGAGTGA", b"AGGAAAGTCTTTTACGCTGGGGTAAGAGTGA", True),
    (b"TGGAAAGTCTTTTACGCTGGGGTAAGAGTGA", b"TCACTCTTACCCCAGCGTAAAAGACTTTCCA", True),
    (b"A" * 16 + b"T" * 15, b"A" * 16 + b"T" * 15, True),
    (b"A" * 15 + b"T" * 16, b"A" * 15 + b"T" * 16, True),  # the centre isn't compared
    (b"AGGAAAGTCTTTTACGCTGGGXXXAGAGTGA", b"AGGAAAGTCTTTTACGCTGGG\0\0\0AGAGTGA", False),
    (b"TGGAAAGTCTTTTACGCTGGGXXXAGAGTGA", b"TCACTCT\0\0\0CCCAGCGTAAAAGACTTTCCA", False),
    (b"A" * 15 + b"x" + b"T" * 15, b"A" * 15 + b"\0" + b"T" * 15, False),
]


def test_canonical_vectors(spark):
    df = spark.createDataFrame([(i, bytearray(a)) for i, (a, _, _) in enumerate(CANONICAL)], "i int, seq binary")
    got = {r.i: (bytes(r.term), r.valid) for r in canonical_windows(df, 31).collect()}
    assert got == {i: (b, ok) for i, (_, b, ok) in enumerate(CANONICAL)}
    assert [sql.canonical(a) for a, _, _ in CANONICAL] == [(b, ok) for _, b, ok in CANONICAL]


def test_windows_at_edges(spark):
    seqs = [b"", b"abc", b"abcd", b"abcde" * 50, None]
    df = spark.createDataFrame([(i, None if s is None else bytearray(s)) for i, s in enumerate(seqs)], "i int, seq binary")
    got = [(r.i, r.pos, bytes(r.term)) for r in windows(df, 4).collect()]
    assert sorted(got) == sorted((i, p, s[p : p + 4]) for i, s in enumerate(seqs) if s for p in range(len(s) - 3))
    long = spark.range(1).select(F.repeat(F.lit("ab"), CHUNK // 2 + 10).cast("binary").alias("seq"))
    assert windows(long, 31).agg(F.count("*"), F.count_distinct("pos"), F.count_distinct("term")).first()[:] == (CHUNK + 20 - 30, CHUNK + 20 - 30, 2)


def test_sizes():
    assert [round(sizing.size_ratio(h, 0.3), 4) for h in (1, 2, 3)] == [2.8037, 2.5206, 2.7102]
    assert [round(sizing.size_ratio(h, 0.1), 4) for h in (1, 2, 3)] == [9.4912, 5.2614, 4.8083]
    assert sizing.signature_size(3120, 1, 0.3) == 8748
    assert abs(sizing.set_bit_ratio(100000, 1, 0.3) - 0.3) < 1e-3
    assert [sizing.page_size(n) for n in (1, 100, 8 * 17**2, 10**12)] == [8, 8, 32, 4096]
    assert sizing.parameters(0, 1, 0.3).keys() == {"ratio"}


def test_packing(spark):
    rng = np.random.default_rng(1)
    for k in (15, 19, 31, 32):
        letters = np.frombuffer(b"ACGT", np.uint8)[rng.integers(0, 4, (20, k))]
        assert (unpack_kmers(pack_kmers(letters), k) == letters).all()
    df = spark.createDataFrame([(bytearray(b"ACGTA"),), (None,)], "t binary")
    assert [r[0] and bytes(r[0]) for r in df.select(unpacked(packed(F.col("t"), 5), 5)).collect()] == [b"ACGTA", None]


def _cortex(name, k, letters):
    packed_ = pack_kmers(letters)
    body = b"".join(bytes(p) + bytes(8 - len(p)) + bytes(5) for p in packed_)
    n = name.encode()
    return b"CORTEX" + struct.pack("<IIII", 6, k, 1, 1) + bytes(12) + struct.pack("<I", len(n)) + n + bytes(16) + bytes(12) + struct.pack("<I", 0) + b"CORTEX" + body


def test_files(spark, tmp_path):
    letters = np.frombuffer(b"ACGT", np.uint8)[np.random.default_rng(2).integers(0, 4, (9, 31))]
    d = tmp_path / "in"
    (d / "sub").mkdir(parents=True)
    (d / "a.txt").write_bytes(b"x" * 76)
    (d / "b.fasta").write_bytes(b">h\nACGT\nAC\n\nGGG\n;c\nT\n")
    (d / "sub" / "c.v1.fasta.gz").write_bytes(gzip.compress(b">h\nACGTA\n"))
    (d / "broken.fasta").write_bytes(b"ACGT\n")
    (d / "r.fastq").write_bytes(b"@1\nACGTACGT\n+\nIIIIIIII\n")
    (d / "m.mfasta").write_bytes(b">a\nAC\nGT\n>b\nTTTTT\n")
    (d / "g.ctx").write_bytes(_cortex("graph", 31, letters))
    (d / "p.km_doc").write_bytes(b"HEAD:DOCUMENT" + struct.pack("<II", 1, 31) + b"pk\0DOCUMENT" + pack_kmers(letters).tobytes())
    (d / "cut.fasta.gz").write_bytes(gzip.compress(b">h\n" + b"ACGTA" * 99 + b"\n")[:-12])
    (d / "bad.fastq.gz").write_bytes(gzip.compress(b"@1\nACGT\n+\nIIII\n")[:12] + b"\xff" * 9)
    (d / "zero.km_doc").write_bytes(b"HEAD:DOCUMENT" + struct.pack("<II", 1, 0) + b"pk\0DOCUMENT" + b"1234")
    (d / "ignored.csv").write_bytes(b"1,2")
    (d / "x.list").write_text("# note\n\nb.fasta\n" + str(d / "a.txt") + "\n")
    found = files.read_files(spark, str(d))
    docs = {r.name: (r.size, r.num_terms) for r in files.documents(found, 4).collect()}
    assert docs == {"a": (76, 73), "b": (21, 3), "c": (docs["c"][0], 2), "r": (23, 5), "m_000000": (4, 1), "m_000001": (5, 2), "graph": (docs["graph"][0], 9 * 28), "pk": (docs["pk"][0], 9 * 28)}
    assert sorted(bytes(r.seq) for r in found.where("name = 'pk'").collect()) == sorted(x.tobytes() for x in letters)
    assert files.documents(files.read_files(spark, str(d / "x.list")), 4).count() == 2
    assert files.documents(files.read_files(spark, str(d), "fastq"), 4).count() == 1
    with pytest.raises(Exception, match="FASTA"):
        files.read_files(spark, str(d / "broken.fasta")).collect()
    with pytest.raises(ValueError):
        file_type_named("nothing")
    letters_only = found.where("name in ('b', 'r', 'c')")
    wrote = {r.path.rsplit("/", 1)[1]: r.n_terms for r in files.write_packed(letters_only, 5, f"file://{tmp_path}/packed").collect()}
    assert wrote == {"b.sig_doc": 2, "r.sig_doc": 4, "c.sig_doc": 1}
    back = files.read_files(spark, f"{tmp_path}/packed")
    assert sorted((r.name, bytes(r.seq)) for r in back.where("seq is not null").collect()) == sorted([("b", b"ACGTA"), ("b", b"CGTAC"), ("c", b"ACGTA"), ("r", b"ACGTA"), ("r", b"CGTAC"), ("r", b"GTACG"), ("r", b"TACGT")])
    listed = DocumentList(spark, str(d / "b.fasta"))
    listed.add(str(d / "a.txt"))
    assert len(listed) == 2 and [r.name for r in listed] == ["a", "b"] and listed[-1].name == "b"
    listed.sort_by_size()
    assert [r.name for r in listed] == ["b", "a"] and listed[0].size == 21
    with pytest.raises(IndexError):
        listed[2]
    (d / "q.txt").write_bytes(b">one\nAC\nGT\n\n;two\nTT\n")
    assert [(r.query_id, r.comment, bytes(r.query)) for r in files.read_queries(spark, str(d / "q.txt")).collect()] == [(0, "one", b"ACGT"), (1, "two", b"TT")]


def _docs(spark, parts, prefix="d"):
    rows = [(f"{prefix}{i:04d}", "text", f"{prefix}{i:04d}", 0, len(p), bytearray(p)) for i, p in enumerate(parts)]
    return spark.createDataFrame(rows, files.SCHEMA)


def test_one_term_documents_score_one(spark):
    text = random_sequence(2000, 5).encode()
    asked = spark.createDataFrame([(0, bytearray(text))], "query_id bigint, query binary")
    parts = [text[31 * i : 31 * i + 31] for i in range(33)]
    for h in (1, 3):
        got = search.search(asked, [build.build_classic(_docs(spark, parts), ClassicParams(num_hashes=h, false_positive_rate=0.001))]).collect()
        assert len(got) == 33 and all(r.score >= 1 for r in got)


def test_store_combine_and_search(spark, tmp_path):
    parts = [random_sequence(400 + 10 * i, i + 1).encode() for i in range(21)]
    params = ClassicParams(num_hashes=2, signature_size=5000)
    index.construct_classic(spark, _docs(spark, parts), f"{tmp_path}/all", params)
    for i in range(3):
        index.construct_classic(spark, _docs(spark, parts[7 * i : 7 * i + 7], f"d{i}"), f"{tmp_path}/p{i}", params)
    index.combine_classic(spark, [f"{tmp_path}/p{i}" for i in (2, 0, 1)], f"{tmp_path}/joined")
    a, b = index.read(spark, f"{tmp_path}/all"), index.read(spark, f"{tmp_path}/joined")
    assert sorted(map(tuple, a.bits.collect())) == sorted(map(tuple, b.bits.collect()))
    query = parts[3][50:150].decode()
    top = index.Index.load(spark, f"{tmp_path}/joined").search(query, 0.8, 3).collect()
    assert (top[0].doc_name, top[0].score, top[0].rank) == ("d00003", 70, 1)
    everything = index.Index.load(spark, f"{tmp_path}/joined", f"{tmp_path}/all", preload=True).search(query)
    assert everything.count() == 42
    with pytest.raises(FileExistsError):
        index.construct_classic(spark, _docs(spark, parts), f"{tmp_path}/all", params)
    index.construct_classic(spark, _docs(spark, parts), f"{tmp_path}/all", params, mode="ignore")
    (tmp_path / "mine").mkdir()
    spark.range(3).write.parquet(f"{tmp_path}/mine/docs")
    for mode in ("errorifexists", "overwrite", "ignore"):
        with pytest.raises(FileExistsError):
            index.construct_classic(spark, _docs(spark, parts), f"{tmp_path}/mine", params, mode=mode)
    assert spark.read.parquet(f"{tmp_path}/mine/docs").count() == 3
    index.construct_compact(spark, _docs(spark, parts), f"{tmp_path}/all", CompactParams(page_size=1), mode="overwrite")
    compact = index.Index.load(spark, f"{tmp_path}/all")
    assert compact.tables[0].pages.count() == 3
    best = compact.search(query, 0.8).first()
    assert (best.doc_name, best.score) == ("d0003", 70)
    assert index.result_lines(compact.search(query, 0.8, 1)).first().value == "d0003\t70"
    with pytest.raises(Exception, match="shorter"):
        compact.search("ACGT").collect()
    with pytest.raises(Exception, match="letter"):
        compact.search("N" * 40).collect()
    sql.register(spark, idx=f"{tmp_path}/all")
    assert spark.sql("SELECT count(*) FROM kmers('ABCDEF', 4)").first()[0] == 3
    assert spark.table("idx_docs").count() == 21


def test_false_positives(spark):
    params = ClassicParams(num_hashes=3, false_positive_rate=0.1)
    tables = build.build_classic(_docs(spark, [random_sequence(3000, i + 1).encode() for i in range(4)]), params)
    asked = workload.random_terms(spark, 10000, 31, 3)
    hits = search.scores(search.query_terms(asked, 31, True), tables).groupBy("slot").count().collect()
    assert all(r["count"] <= 1070 for r in hits)
    histogram = {r.score: r.pairs for r in workload.score_histogram(search.scores(search.query_terms(asked, 31, True), tables), 10000, 4).collect()}
    assert sum(histogram.values()) == 40000


def test_streams(spark, tmp_path):
    parts = [random_sequence(300, i + 1).encode() for i in range(5)]
    _docs(spark, parts[:3]).write.parquet(f"{tmp_path}/docs")
    stream = spark.readStream.schema(files.SCHEMA).parquet(f"{tmp_path}/docs")
    streams.ingest_stream(stream, f"{tmp_path}/index", f"{tmp_path}/c1").awaitTermination()
    _docs(spark, parts[3:], "e").write.mode("append").parquet(f"{tmp_path}/docs")
    streams.ingest_stream(stream, f"{tmp_path}/index", f"{tmp_path}/c1").awaitTermination()
    both = streams.load_all(spark, f"{tmp_path}/index")
    assert [t.meta.num_docs for t in both.tables] == [3, 2]
    spark.createDataFrame([(7, bytearray(parts[4][10:90]))], "query_id bigint, query binary").write.parquet(f"{tmp_path}/q")
    asked = spark.readStream.schema("query_id bigint, query binary").parquet(f"{tmp_path}/q")
    streams.search_stream(asked, both.tables, f"{tmp_path}/out", f"{tmp_path}/c2").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert [(r.query_id, r.index_no, r.doc_name, r.score) for r in got] == [(7, 1, "e0001", 50)]


def test_tools(spark, tmp_path, capsys):
    text = [random_sequence(300 + i, i + 1) for i in range(6)]
    (tmp_path / "in").mkdir()
    for i, x in enumerate(text):
        (tmp_path / "in" / f"d{i}.fasta").write_text(f">h\n{x}\n")

    def run(*words):
        main([str(w) for w in words])
        return capsys.readouterr().out.splitlines()

    found = run("doc-list", tmp_path / "in", "--file-type", "fasta")
    assert [x.split("\t")[2] for x in found[:-1]] == [str(270 + i) for i in range(6)] and '"total": 1635' in found[-1]
    assert run("doc-dump", tmp_path / "in" / "d0.fasta", "--no-canonicalize")[0] == "d0\t" + text[0][:31]
    run("classic-construct", tmp_path / "in", tmp_path / "classic", "--num-hashes", 2, "--signature-size", 4000)
    run("compact-construct", tmp_path / "in", tmp_path / "compact", "--page-size", 1)
    for at in ("classic", "compact"):
        assert run("query", tmp_path / at, "--query", text[2][20:120], "--limit", 1) == ["d2\t70"]
    (tmp_path / "q").write_text(f">one\n{text[1][:50]}\n;two\n{text[4][:40]}\n{text[4][40:60]}\n")
    assert run("query", tmp_path / "classic", "--file", tmp_path / "q", "--threshold", 1) == ["*one\t1", "d1\t20", "*two\t1", "d4\t30"]
    with pytest.raises(SystemExit):
        run("query", tmp_path / "classic")
    run("classic-construct-random", tmp_path / "random", "--num-documents", 8, "--document-size", 50, "--signature-size", 500)
    run("compact-construct-combine", tmp_path / "random", tmp_path / "joined", "--page-size", 1)
    assert index.read(spark, f"{tmp_path}/joined").docs.count() == 8
    assert run("print-parameters", "--num-elements", 3120) == ['{"ratio": 2.8036732520571284, "signature_size": 8748, "signature_bytes": 1093}']
    assert run("print-kmers", "AGGAAAGTCTTTTACGCTGGGGTAAGAGTGAC") == ["AGGAAAGTCTTTTACGCTGGGGTAAGAGTGA", "GGAAAGTCTTTTACGCTGGGGTAAGAGTGAC"]
    times, *histogram = run("benchmark-fpr", tmp_path / "classic", "--queries", 20, "--num-kmers", 30, "--warmup", 2, "--fpr-dist")
    assert '"hashes"' in times and sum(int(x.split("\t")[1]) for x in histogram) == 20 * 6
    run("generate-queries", tmp_path / "in", tmp_path / "made", "--positive", 5, "--negative", 5, "--true-negatives", "--size", 40)
    made = files.read_queries(spark, f"{tmp_path}/made").collect()
    assert sorted(len(r.query) for r in made) == [40] * 10 and sum(r.comment.startswith("negative") for r in made) == 5


def test_one_family_for_real(spark):
    """The default family against plain hashing of every window."""
    docs = [random_sequence(200, i + 1).encode() for i in range(5)]
    asked = docs[2][30:100]
    for h in (1, 3):
        size = 700
        rows = [{xxhash.xxh64_intdigest(d[i : i + 31], seed=j) % size for j in range(h) for i in range(170)} for d in docs]
        want = {f"d{n:04d}": sum(all(xxhash.xxh64_intdigest(asked[i : i + 31], seed=j) % size in r for j in range(h)) for i in range(40)) for n, r in enumerate(rows)}
        built = build.build_classic(_docs(spark, docs), ClassicParams(num_hashes=h, signature_size=size, canonicalize=False))
        stored = build.Tables(built.meta, built.pages, built.docs, built.bits)
        for tables in (built, stored):
            got = search.search(spark.createDataFrame([(0, bytearray(asked))], "query_id bigint, query binary"), [tables]).collect()
            assert {r.doc_name: r.score for r in got} == want
    first = search.first_found(spark.createDataFrame([(0, 0, 2, 9), (0, 0, 1, 1), (0, 0, 3, 5)], "query_id int, index_no int, doc_id int, score int"), 2).collect()
    assert sorted((r.doc_id, r.score, r.rank) for r in first) == [(1, 1, 1), (2, 9, 2)]


def test_empty_corpus(spark):
    none = spark.createDataFrame([], files.SCHEMA)
    asked = spark.createDataFrame([(0, bytearray(b"A" * 40))], "query_id bigint, query binary")
    assert search.search(asked, [build.build_classic(none)], 0.5).count() == 0
    assert search.search(asked, [build.build_compact(none)]).count() == 0

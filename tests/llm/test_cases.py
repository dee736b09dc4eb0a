"""Cases made for one operator: hot groups, ids of other types, bounds, planted rows and plain twins of trained models."""

import cProfile
import collections
import hashlib
import itertools
import re
import time

import corpus_pipeline
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from sigspark.llm import decontaminate, langid, lines, neighbours, repeats, sentencepieces, simhash, toxicity, urls
from sigspark.llm.common import BLOB_SCHEMA, Packer, exchange, text_slices, unpacked

WORDS = [f"w{i}" for i in range(4000)]


def _text(rng, n):
    return " ".join(rng.choice(WORDS, n))


def test_ids_of_other_types(spark):
    rng = np.random.default_rng(1)
    shared = _text(rng, 80)
    rows = [("b", shared), ("a", _text(rng, 200) + " " + shared), ("c", _text(rng, 90)), (None, shared)]
    for kind, ids in (("string", ("a", "b")), ("int", (1, 2))):
        df = spark.createDataFrame([(i if kind == "string" or i is None else ord(i) - 96, t) for i, t in rows], f"doc_id {kind}, text string")
        assert [(r.doc_id, r.source_id, r.n_words) for r in repeats.repeats(df).collect()] == [(ids[1], ids[0], 80)]
        copies = df.union(df.where(F.col("doc_id") == ids[0]).withColumn("doc_id", F.lit("z" if kind == "string" else 26).cast(kind)))
        last = "z" if kind == "string" else 26
        assert {(r.doc_id, r.group_id, r.kept) for r in simhash.groups(copies).collect()} == {(ids[0], ids[0], True), (last, ids[0], False)}
        assert simhash.keep_one(copies).count() == 4 and lines.drop_duplicates(copies).count() == 4
        assert {(r.doc_id, r.group_doc) for r in lines.duplicates(copies).collect()} == {(ids[0], ids[0]), (last, ids[0])}
    vectors = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [1.0, 0.5]), ("z", [0.0, 1.0])], "vec_id string, embedding array<float>")
    assert [(r.vec_id, r.neighbour_id) for r in neighbours.neighbours(vectors, k=1).orderBy("vec_id").collect()] == [("x", "y"), ("y", "x"), ("z", "y")]


def test_parts_beyond_partitions(spark):
    kind = np.dtype([("key", "<u8"), ("n", "<i4")])

    def make(batches):
        packer = Packer(37)
        for batch in batches:
            r = np.zeros(batch.num_rows, kind)
            r["key"] = r["n"] = batch.column(0).to_numpy()
            yield from packer.add(r["key"], r)
        yield from packer.flush()

    def sums(batches):
        import pyarrow as pa

        for r in unpacked(batches, kind):
            assert len(np.unique(r["key"] % np.uint64(37))) == 1
            yield pa.RecordBatch.from_arrays([pa.array([int(r["key"][0]) % 37]), pa.array([int(r["n"].sum())])], ["k", "s"])

    got = {r.k: r.s for r in exchange(spark.range(0, 1000, 1, 5).mapInArrow(make, BLOB_SCHEMA), 37).mapInArrow(sums, "k bigint, s bigint").collect()}
    assert got == {k: sum(range(k, 1000, 37)) for k in range(37)}


def test_hot_bucket_of_lines_is_cut_without_loss(spark):
    rng = np.random.default_rng(2)
    base = _text(rng, 30)
    texts = [base.replace(f"{base.split()[i % 30]} ", f"{WORDS[i]} ", 1) for i in range(60)] + [_text(rng, 30) for _ in range(5)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    whole, cut = ({(r.doc_id, r.group_doc) for r in lines.duplicates(df, hot).collect()} for hot in (5000, 7))
    assert whole == cut and len(whole) >= 55
    found = spark.createDataFrame([(1, i) for i in range(20)] + [(2, i) for i in range(3)], "bucket bigint, line bigint")
    met = collections.defaultdict(set)
    for r in lines.chunk_pairs(found, 4).collect():
        met[r.bucket, r.cell].add(r.line)
    assert max(len(m) for m in met.values()) < 20 and all(any({a, b} <= m for (k, _), m in met.items() if k == 1) for a in range(20) for b in range(20))
    assert met[2, 0] == {0, 1, 2}


def test_large_bucket_of_unlike_lines_is_quick():
    rng = np.random.default_rng(12)
    sets = [set(rng.choice(8000, 700, replace=False).tolist()) for _ in range(900)]
    sets += [s ^ set(rng.choice(8000, 60, replace=False).tolist()) for s in sets[:50]]
    began = time.process_time()
    edges = lines.joined(sets)
    assert time.process_time() - began < 6
    assert sorted(edges) == [(i, i + 900) for i in range(50)]


def test_shingles_are_characters():
    a, b = "政府今天宣布了新的措施以保护环境和经济发展", "政府今天宣布了新的措施以保护环境和经济発展"
    assert len(lines.shingles(a.encode()) & lines.shingles(b.encode())) == len(a) - 4 - 2
    x = np.frombuffer(("é" + a + "\nabc défgh").encode(), np.uint8)
    made = lines.Lines()
    made.load(x, np.array([0, len(x)]))
    assert (made.last - made.first).tolist() == [len(a) + 1, 9]


def test_short_parts_are_merged_at_once(monkeypatch):
    monkeypatch.setattr(sentencepieces, "PARTS", 500)
    m = sentencepieces.Lattice(*sentencepieces.read_pieces(sentencepieces.MODEL))
    rng = np.random.default_rng(13)
    texts = ["".join(rng.choice(list("aeiou\u00df\u00f1\u653f\u2581 \n\tthnzq,.%#0\U0001f642"), rng.integers(1, 90))) for _ in range(1500)]
    monkeypatch.setattr(m, "solve", lambda s: pytest.fail("one by one") if len(s) <= sentencepieces.SHORT else sentencepieces.Lattice.solve(m, s))
    got = [None, b""] + [x for at in range(0, 1500, 100) for x in m.encode(texts[at : at + 100])]
    assert got[:2] == m.encode([None, ""])
    monkeypatch.undo()
    for text, ids in zip(texts, got[2:]):
        parts = m.split(sentencepieces.SPACE + text.replace(" ", sentencepieces.SPACE))
        assert tuple(np.frombuffer(ids, "<i4").tolist()) == m.ids(x for p in parts for x in m.merge(p))


def test_new_parts_take_a_fraction_of_one_by_one():
    m = sentencepieces.Lattice(*sentencepieces.read_pieces(sentencepieces.MODEL))
    rng = np.random.default_rng(17)
    ends = ["an", "en", "er", "tion", "ch", "heit", "ou", "que", "re", "th", "ing", "bl", "\u00e9", "sch", "\u00f1", "eau"]
    words = sorted({sentencepieces.SPACE + "".join(rng.choice(ends, rng.integers(2, 6))) for _ in range(30000)}, key=len)

    def seconds(run):
        took = []
        for _ in range(3):
            began = time.process_time()
            got = run()
            took.append(time.process_time() - began)
        return min(took), got

    one, want = seconds(lambda: [np.array(m.ids(m.merge(w)), "<i4").tobytes() for w in words[::8]])
    every, got = seconds(lambda: [x for at in range(0, len(words), 4096) for x in m.merge_all(words[at : at + 4096])])
    assert got[::8] == want and every < 2 * one


def test_chunks_are_searched_at_their_ends_alone():
    m = sentencepieces.Lattice(*sentencepieces.read_pieces(sentencepieces.MODEL))
    text = " ".join(f"w\u00f6rd{i} of the text\n" for i in range(3000))
    want, reads = m.encode([text])[0], []

    class Letters(set):
        def __contains__(self, c):
            reads.append(c)
            return super().__contains__(c)

    m.letters = Letters(m.letters)
    rows = list(sentencepieces.cut(sentencepieces.SPACE + text.replace(" ", sentencepieces.SPACE), 1 << 14, m.longest))
    states = sentencepieces.cut_states([m.matrix(*r[2:]) for r in rows])
    assert len(reads) < 200 * len(rows)
    assert b"".join(bytes(m.backtrace(*r[2:], *at)) for r, at in zip(rows, states)) == want


def test_large_buckets_of_fingerprints_equal_all_pairs():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, (6, 4)).astype(np.uint64)
    f = centres[rng.integers(0, 6, 400)]
    for _ in range(3):
        f = f ^ (np.uint64(1) << rng.integers(0, 64, f.shape).astype(np.uint64))
    f[:50] ^= (np.uint64(0xFFFF) << np.uint64(7))  # chains of stars
    d = np.bitwise_count(f[:, None] ^ f[None]).sum(2)
    a, b = np.nonzero(np.triu(d <= simhash.RADIUS, 1))

    def parts(a, b):
        m, l = simhash.spanning(np.asarray(a), np.asarray(b))
        root = np.arange(len(f))
        root[m] = l
        return root.tolist()

    assert parts(*simhash.large_bucket(f)) == parts(a, b)


def test_large_bucket_of_unrelated_fingerprints_is_quick():
    rng = np.random.default_rng(11)
    f = np.packbits(rng.random((2000, 256)) < 0.38, axis=1).view(np.uint64)
    f[1500:] = f[:500] ^ (np.uint64(1) << rng.integers(0, 64, (500, 4)).astype(np.uint64))
    began = time.process_time()
    a, b = simhash.large_bucket(f)
    assert time.process_time() - began < 5
    assert sorted(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist())) == [(i, i + 1500) for i in range(500)]


def test_hot_bucket_of_fingerprints_is_cut_without_loss(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, (1, 4))
    f = np.repeat(base, 300, 0) ^ (np.int64(1) << rng.integers(0, 20, (300, 4)))
    f = np.unique(np.concatenate([f, rng.integers(0, 2**63, (100, 4))]), axis=0)
    df = spark.createDataFrame([(i, *map(int, row)) for i, row in enumerate(f)], "doc_id bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint")
    monkeypatch.setattr(simhash, "SIGNS", 10)
    key, chunks = simhash.hot_keys(df.withColumnRenamed("doc_id", "rep"), len(f), 16, 8, 40)
    assert len(key) and (chunks > 2).any()
    whole, cut = ({(r.doc_id, r.group_id) for r in simhash._groups(df, hot).collect()} for hot in (simhash.HOT, 40))
    assert whole == cut and len(whole) >= 290
    ids = np.arange(50)
    row, cell = simhash.cells(np.full(50, 7, np.uint64), ids, np.array([7], np.uint64), np.array([4]))
    met = collections.defaultdict(set)
    for r, c in zip(row.tolist(), cell.tolist()):
        met[c].add(r)
    assert len(met) == 10 and all(any({a, b} <= m for m in met.values()) for a in range(50) for b in range(50))


def test_buckets_of_millions_of_fingerprints_are_quick():
    rng = np.random.default_rng(15)
    sizes = [3] * 3000 + [20] * 500 + [100] * 100 + [400] * 10
    r = np.zeros(sum(sizes), simhash.RECORD)
    r["key"], r["id"] = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(r))
    r["f"] = np.packbits(rng.random((len(r), 256)) < 0.38, axis=1).view(np.uint64)
    near = np.flatnonzero(np.diff(r["key"]) == 0)[::50]
    r["f"][near + 1] = r["f"][near] ^ np.uint64(0xFF0)
    began = time.process_time()
    a, b = simhash.bucket_edges(r[rng.permutation(len(r))])
    assert time.process_time() - began < 4
    assert sorted(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist())) == [(i, i + 1) for i in near.tolist()]


def test_fingerprints_look_known_words_up_at_once(monkeypatch):
    rng = np.random.default_rng(14)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 3000, n)).encode() for n in (0, 1, 2, 300, 700, *[400] * 60)] + [None, b"."]
    hasher = simhash.Hasher()
    f, some = hasher.fingerprints(texts)
    for text, row, has in zip(texts, f, some):
        words = set((text or b".").replace(b".", b"").split())
        bits = sum((np.unpackbits(np.frombuffer(hashlib.md5(w).digest() + hashlib.md5(b"+" + w).digest(), np.uint8)).astype(int) for w in words), np.zeros(256, int))
        assert has == bool(words) and (np.packbits(2 * bits > len(words)).view(">u8") == row).all()
    calls = cProfile.Profile()
    again, _ = calls.runcall(hasher.fingerprints, texts)
    assert (again == f).all() and sum(x.callcount for x in calls.getstats()) < 2000  # of 20,000 words
    monkeypatch.setattr(simhash, "REMEMBERED", 100)
    small = simhash.Hasher()
    assert (np.concatenate([small.fingerprints(texts[at : at + 5])[0] for at in range(0, len(texts), 5)]) == f).all()


def test_plan_keeps_buckets_small():
    assert simhash.plan(1000) == simhash.plan(1 << 20) == (16, 8)
    for n in (1 << 24, 1 << 30):
        bits, orders = simhash.plan(n)
        assert n >> bits <= 32
        missed = (1 - (1 - simhash.RADIUS / simhash.BITS) ** bits) ** (orders * (simhash.BITS // bits))
        assert missed <= 2 / simhash.MISSED


def test_passages_are_removed(spark):
    rng = np.random.default_rng(4)
    shared, own = _text(rng, 60), [_text(rng, 30) for _ in range(3)]
    rows = [(1, f"{own[0]}. {shared}! {own[1]}", 1, "x"), (2, f"{own[2]}; {shared}; end", 2, "y"), (3, shared, 3, "z"), (3, shared, 3, "z"), (4, None, None, None), (5, "..", 2, None), (None, shared + " more", 4, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint, Number string")
    got = repeats.drop_repeats(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text, r.n_chars, r.Number) for r in got.collect()), key=str) == sorted([(1, f"{own[0]}. {own[1]}", len(own[0]) + 2 + len(own[1]), "x"), (2, f"{own[2]}; end", len(own[2]) + 5, "y"), (4, None, None, None), (5, "..", 2, None), (None, shared + " more", 4, None)], key=str)
    assert repeats.repeats(got).count() == 0 and repeats.drop_repeats(df.where("false")).count() == 0
    assert repeats.without(b"a b c", [[0, 3]]) is None and repeats.without("é b, c d".encode(), [[1, 1], [2, 1]]) == "é d"


def test_short_test_strings(spark):
    bench = spark.createDataFrame([(1, "Yes"), (1, "new york city is a large place of its own kind"), (2, "x y"), (3, "é")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "well, yes."), (2, "new YORK city is a large place"), (3, "x-y yes"), (4, "yesterday"), (5, "É"), (6, None)], "doc_id bigint, text string")
    assert {(r.doc_id, r.item_id, r.n_windows) for r in decontaminate.leaks(docs, bench).collect()} == {(1, 1, 1), (3, 1, 1), (3, 2, 1), (5, 3, 1)}
    wide = docs.union(spark.createDataFrame([(7, "Yes, New York City is a large place of its own kind")], docs.schema))
    assert {(r.doc_id, r.n_windows) for r in decontaminate.leaks(wide, bench, most=10).where("item_id = 1").collect()} == {(1, 1), (3, 1), (7, 5)}
    assert {r.doc_id for r in decontaminate.drop_leaks(wide, bench).collect()} == {1, 2, 3, 4, 5, 6}


def test_planted_hosts_held_out(spark):
    rng = np.random.default_rng(5)
    bad, good = ["casino", "bonus", "pills", "cheap", "jackpot"], ["river", "museum", "school", "garden", "library"]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(bad if i % 2 else good, 20)) + " some words of no side") for i in range(200)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(0, 120)], "doc_id bigint, quality int")
    pages = spark.createDataFrame([(i, f"http://www.{''.join(rng.choice(bad if i % 2 else good, 2, replace=False))}.example/p/{i}") for i in range(200)], "page_id bigint, url string")
    rows = urls.filter_urls(pages, docs, labels).where("page_id >= 120").collect()  # pages without a label
    assert len(rows) == 80 and sum(r.blocked == (r.page_id % 2 == 1) for r in rows) >= 78
    assert all(set(r.words.split()) <= {*bad, *good, "www", "example"} for r in rows)
    assert urls.filter_urls(pages.limit(1).withColumn("url", F.lit("http://" + "q" * 3000 + ".com/1")), docs, labels).first().words == "q" * 3000 + " com"


def test_samples_are_bounded(spark):
    many = spark.range(3000).select(F.lit(None).cast("bigint").alias("doc_id"), F.concat(F.lit("the same id "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    sizes = []
    real = langid.pieces
    try:
        langid.pieces = lambda texts, *a, **k: sizes.append(len(texts)) or real(texts, *a, **k)
        langid.train(many.union(many.limit(100)), per_language=400)
        langid.train(many, per_language=400, most_bytes=200)
    finally:
        langid.pieces = real
    assert 100 <= max(sizes[:2]) <= 400 and max(sizes[2:]) <= 20
    seen = []
    fit = toxicity.fit
    try:
        toxicity.fit = lambda texts, positive, prior: seen.append(len(texts)) or fit(texts, positive, prior)
        docs = spark.range(9000).select((F.col("id") % 3).alias("doc_id"), F.col("id").cast("string").alias("text"))
        toxicity.train(docs, spark.createDataFrame([(0, 1), (1, 0)], "doc_id bigint, toxic int"))
    finally:
        toxicity.fit = fit
    assert seen == [4]


def test_labels_equal_plain_cosines(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.train(docs)
    index = {}
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    for r in docs.collect():
        x = [int(langid.LETTERS[b]) for b in (r.text or "").lower().encode()]
        tf = collections.Counter()
        for i in range(len(x) - 2):
            if x[i : i + 3] != [32, 32, 32]:
                code = x[i] | x[i + 1] << 8 | x[i + 2] << 16
                tf[index.setdefault(code, ((code * 2654435761) & 0xFFFFFFFF) >> (32 - langid.BITS))] += 1
        v = np.zeros(langid.DIM)
        for k, n in tf.items():
            v[k] = np.log1p(n) * model.idf[k]
        found = got[r.doc_id]
        if not v.any():
            assert found.pred_lang is None and found.rejected and found.cosine == 0
            continue
        cos = model.centroids @ v / np.linalg.norm(v)
        best = int(cos.argmax())
        assert found.pred_lang == model.languages[model.owner[best]] and abs(found.cosine - cos[best]) < 1e-4
        limit = model.floor[best, min(int(np.log2(np.count_nonzero(v))), langid.BANDS - 1)]
        assert found.rejected == (cos[best] < limit) or abs(cos[best] - limit) < 1e-4


def test_scores_equal_plain_sums(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    roller = toxicity.Roller(0x9E3779B97F4A7C15)
    weights = {}

    def weight(word):
        if word not in weights:
            data = np.frombuffer(word, np.uint8)
            weights[word] = model.weights[toxicity.word_bags(data, np.array([0, len(data)]), roller)[1]]
        return weights[word]

    def bucket(word):
        data = np.frombuffer(word, np.uint8)
        return int(toxicity.word_bags(data, np.array([0, len(data)]), roller)[1][0])

    got = {r.doc_id: r for r in toxicity.classify(docs, model).collect()}
    table = bytes(b if toxicity.WORD[b] else 32 for b in range(256))
    names: dict[bytes, int] = {}
    for r in docs.collect():
        words = set((r.text or "").lower().encode().translate(table).split())
        for w in words - names.keys():
            names[w] = bucket(w)
        z = model.bias + sum(model.weights[b] for b in {names[w] for w in words})
        assert abs(got[r.doc_id].score - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9 and got[r.doc_id].toxic == (got[r.doc_id].score > 0.5)


def test_slices_of_rows():
    import pyarrow as pa

    got = [(at, len(o) - 1) for at, _, o in text_slices(pa.array(["a"] * 1000), rows=300)]
    assert got == [(0, 300), (300, 300), (600, 300), (900, 100)]


@pytest.mark.parametrize("nearest", ["de", "en", "es", "fr"])
def test_every_language_rejects(spark, nearest):
    """Foreign text and noise whose nearest centroid is this language's."""
    rng = np.random.default_rng(6)
    docs = spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.1')}/documents.parquet")
    model = langid.train(docs)
    others = docs.where(F.col("lang") != nearest).where("length(text) > 100").limit(200).select("text").toArrow().column(0).to_pylist()
    only = langid.Model([nearest], model.idf, model.centroids[[model.languages[o] == nearest for o in model.owner]], np.zeros(sum(model.languages[o] == nearest for o in model.owner), np.int64), model.floor[[model.languages[o] == nearest for o in model.owner]])
    noise = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz     "), 200)) for _ in range(100)]
    rows = spark.createDataFrame([(i, t, None) for i, t in enumerate(others + noise)], "doc_id bigint, text string, lang string")
    assert langid.identify(rows, only).agg(F.avg(F.col("rejected").cast("double"))).first()[0] >= 0.9
    own = docs.where(F.col("lang") == nearest).where("length(text) > 40")
    assert langid.identify(own, model).agg(F.avg((~F.col("rejected")).cast("double"))).first()[0] >= 0.97


def _components(n, edges):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in edges:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def _without_lines(rows):
    places = collections.defaultdict(list)
    for r in rows:
        for n, line in enumerate((r["text"] or "").split("\n")):
            if re.search(r"[^\x00-\x20]", line):
                places[re.sub("[A-Z]", lambda m: m[0].lower(), line)].append((r["doc_id"], n))
    names = sorted(places, key=lambda x: min(places[x]))
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} for x in names]
    edges = [(i, j) for i, j in itertools.combinations(range(len(names)), 2) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    groups, gone = collections.defaultdict(list), set()
    for x, g in zip(names, _components(len(names), edges)):
        groups[g] += places[x]
    for g in groups.values():
        gone |= set(g) - {min(g)}
    out = {}
    for r in rows:
        lines_ = (r["text"] or "").split("\n")
        kept = [x for n, x in enumerate(lines_) if (r["doc_id"], n) not in gone]
        if len(kept) == len(lines_) or re.search(r"[^\x00-\x20]", "\n".join(kept)):
            out[r["doc_id"]] = "\n".join(kept)
    return out


def _without_copies(rows):
    prints = []
    for r in rows:
        words = set(re.findall("[0-9a-z\x80-\U0010ffff]+", r["text"].lower()))
        raw = [np.unpackbits(np.frombuffer(hashlib.md5(w.encode()).digest() + hashlib.md5(b"+" + w.encode()).digest(), np.uint8)) for w in words]
        prints.append((2 * np.sum(raw, axis=0, dtype=int) > len(words)) if words else None)
    order = sorted(range(len(rows)), key=lambda i: rows[i]["doc_id"])
    edges = [(a, b) for a, b in itertools.combinations(range(len(order)), 2) if prints[order[a]] is not None and prints[order[b]] is not None and (prints[order[a]] != prints[order[b]]).sum() <= simhash.RADIUS]
    return {rows[order[i]]["doc_id"] for i, g in enumerate(_components(len(order), edges)) if i == g}


def test_each_stage_equals_brute_force(spark):
    given = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect()]
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    long = next(r["text"] for r in given if 800 < len(r["text"]) < 3000).replace("\n", " ").split()
    planted = ["Российская академия наук опубликовала новый отчёт о состоянии климата " * 5, "xqzj vkwp zzgh qpwx jvbn kqxz wvtr pqlm " * 20, " ".join(long), " ".join([*long[:40], "changed", *long[41:]]), " ".join(long[:-1]), bench[0], "Before. " + bench[1].upper() + " After.", "", None, given[5]["text"]]
    base = max(r["doc_id"] for r in given) + 1
    docs = spark.createDataFrame([tuple(r.values()) for r in given] + [(base + i, t, "en" if i > 1 else None, "planted", len(t or "")) for i, t in enumerate(planted)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "simhash_near_dedup", "decontamination", "sentencepiece"]
    now = docs.collect()
    model = langid.train(docs)
    want = []
    for r in now:
        data = np.frombuffer((r.text or "").lower().encode(), np.uint8)
        if not model.label(data, np.array([0, len(data)]))[2][0]:
            want.append(tuple(r))
    now = stages["language_id"](spark, docs, SF).collect()
    assert sorted(map(tuple, now), key=str) == sorted(want, key=str)
    assert not {base, base + 1, base + 7, base + 8} & {r.doc_id for r in now} and base + 2 in {r.doc_id for r in now}

    want = _without_lines(now)
    after = stages["line_dedup"](spark, spark.createDataFrame(now, docs.schema), SF).collect()
    got = {r.doc_id: r.text for r in after}
    assert all(r.n_chars == len(r.text) for r in after if r.text != {x.doc_id: x.text for x in now}[r.doc_id])
    assert len(got.keys() ^ want.keys()) + sum(got[i] != want[i] for i in got.keys() & want.keys()) <= 0.03 * len(now)  # recall of the bands

    for rows in (now, after):  # the stage on its own input, and on one that still has the copies
        df = spark.createDataFrame(rows, docs.schema)
        assert {r.doc_id for r in stages["simhash_near_dedup"](spark, df, SF).collect()} == _without_copies(rows)
    now = stages["simhash_near_dedup"](spark, spark.createDataFrame(after, docs.schema), SF).collect()

    flat = [" ".join(w[i : i + 8]) for w in (re.findall("[0-9a-z\x80-\U0010ffff]+", b.lower()) for b in bench) for i in range(max(1, len(w) - 7)) if len(w) >= 5]
    clean = [r for r in now if not any(f" {p} " in " " + " ".join(re.findall("[0-9a-z\x80-\U0010ffff]+", r.text.lower())) + " " for p in flat)]
    left = stages["decontamination"](spark, spark.createDataFrame(now, docs.schema), SF).collect()
    assert sorted(map(tuple, left)) == sorted(map(tuple, clean)) and len(clean) < len(now)
    out = stages["sentencepiece"](spark, spark.createDataFrame(left, docs.schema), SF)
    assert out.count() == len(left) and out.where("not round_trip").count() == 0
    extra = docs.withColumns({"Lowered": F.lit(1), "gone_lines": F.lit(2), "GONE_DOC": F.lit(3), "gone": F.lit(4)})
    for name in list(stages)[:-1]:
        assert stages[name](spark, extra, SF).columns == extra.columns and stages[name](spark, extra.where("false"), SF).count() == 0
    assert stages["sentencepiece"](spark, extra.where("false"), SF).count() == 0

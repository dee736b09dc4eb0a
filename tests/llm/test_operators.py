import collections
import itertools
import math
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline
from sigspark.llm import chat_format, decontaminate, langid, lines, neighbours, registry, repeats, sentencepieces, simhash, toxicity, urls
from sigspark.llm.common import connected_components


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(same, name):
    same(registry.QUERIES[name], registry.ORACLE_SQL[name])


LONG = " ".join(f"word{i % 7919}" for i in range(30000))
TEXTS = [None, "", " \n ", "short", LONG, LONG, "a line that is long enough to have shingles\n" * 3, "é ü ñ — 日本語テキスト"]
#: Names that the operators use themselves.
CLASHING = ("Lowered", "GONE_LINES", "gone_doc_", "Number", "ranges", "name_", "number_", "bytes_", "cell", "row", "k", "l", "key", "id", "hash", "line", "part", "blob", "gone", "gone_doc", "root", "node", "i", "token", "low", "rep", "f0")


def _extra(*without):
    return {c: F.lit(1) for c in CLASHING if c not in without}


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i % 2 else None, "s", None) for i, t in enumerate(TEXTS)] + [(4, LONG, "en", "s", 1), (None, "a null id", "en", None, None), (3, "another text under one id", None, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumns(_extra())


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "a line that is long enough to have shingles"), (2, None), (None, "x"), (3, "")], "item_id bigint, text string").withColumns(_extra())
    labels = spark.createDataFrame([(4, 1, 1), (6, 0, 0), (None, 1, 1), (5, None, None)], "doc_id bigint, quality int, toxic int").withColumns(_extra("low"))
    passages = repeats.repeats(odd).collect()
    assert {(r.doc_id, r.source_id) for r in passages} >= {(5, 4)} and all(r.n_words >= 50 for r in passages)
    found = {(r.doc_id, r.line): (r.group_doc, r.group_line, r.kept) for r in lines.duplicates(odd).collect()}
    assert found == {(4, 0): (4, 0, True), (5, 0): (4, 0, False), **{(6, n): (6, 0, n == 0) for n in range(3)}}
    left = lines.drop_duplicates(odd)
    assert left.columns == odd.columns and {r.doc_id: r.text for r in left.where("doc_id in (4, 5, 6)").collect()} == {4: LONG, 6: "a line that is long enough to have shingles\n"}
    assert {(r.doc_id, r.item_id, r.n_windows) for r in decontaminate.leaks(odd, bench, least=2).collect()} == {(6, 1, 2)}
    assert decontaminate.drop_leaks(odd, bench).count() == odd.count() - 1
    groups = {(r.doc_id, r.group_id, r.kept) for r in simhash.groups(odd).collect()}
    assert groups == {(4, 4, True), (5, 4, False)}
    assert simhash.keep_one(odd).count() == odd.count() - 1
    named = langid.identify(odd)
    assert named.count() == odd.count() and {r.doc_id for r in named.where("pred_lang is null").collect()} >= {0, 1, 2}
    scores = toxicity.classify(odd, toxicity.train(odd, labels))
    assert scores.count() == odd.count() and not scores.where("doc_id in (0, 1, 2) and toxic").count()
    ids = sentencepieces.encode(odd)
    assert ids.count() == odd.count() and ids.where("doc_id = 0 and ids is null").count() == 1 and ids.where("doc_id > 0 and not round_trip").count() == 0
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "http://a-b.example.org/en/4"), (3, "http://a-b.example.org/en/4"), (4, "x" * 5000)], "page_id bigint, url string").withColumns(_extra())
    assert urls.filter_urls(pages, odd, labels).count() == 5
    turns = spark.createDataFrame([(1, 2, "user", "b"), (1, 1, None, None), (1, 2, "user", "b"), (None, 1, "bot", "x")], "conv_id bigint, turn bigint, role string, text string").withColumns(_extra())
    chats = {r.conv_id: (r.n_turns, r.n_messages, r.chat) for r in chat_format.format_chats(turns).collect()}
    assert chats[1] == (3, 2, "<|unknown|>\n<|end|>\n<|user|>\nb\nb<|end|>\n") and chats[None] == (1, 1, "<|bot|>\nx<|end|>\n")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0]), (4, [float("nan"), 1.0]), (5, [1.0]), (6, None), (None, [1.0, 0.0]), (7, [1.0, None])], "vec_id bigint, embedding array<float>").withColumns(_extra())
    near = [(r.vec_id, r.rank, r.neighbour_id, r.similarity) for r in neighbours.neighbours(vectors).orderBy("vec_id", "rank").collect()]
    assert near == [(1, 1, 3, 0.707107), (1, 2, 2, 0.0), (2, 1, 1, 0.0), (2, 2, 3, 0.0), (3, 1, 1, 0.707107), (3, 2, 2, 0.0)]
    for empty in (repeats.repeats(none), lines.duplicates(none), lines.drop_duplicates(none), decontaminate.leaks(none, bench), decontaminate.leaks(odd, bench.where("false")), simhash.groups(none), langid.identify(none), toxicity.classify(none, toxicity.train(none, labels)), sentencepieces.encode(none), urls.filter_urls(pages.where("false"), none, labels), chat_format.format_chats(turns.where("false")), neighbours.neighbours(vectors.where("false"))):
        assert empty.count() == 0


def test_cover_is_a_difference_set():
    d = {(a - b) % repeats.PERIOD for a in repeats.COVER for b in repeats.COVER}
    assert d == set(range(repeats.PERIOD))


def test_lines_against_all_pairs(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    places = collections.defaultdict(list)
    for d in docs:
        for n, line in enumerate((d["text"] or "").encode().split(b"\n")):
            if line.strip():
                places[bytes(lines._SMALL[np.frombuffer(line, np.uint8)])].append((d["doc_id"], n))
    names = sorted(places)
    sets = [lines.shingles(x) for x in names]
    edges = []
    for i, j in itertools.combinations(range(len(names)), 2):
        a, b = sets[i], sets[j]
        if a and b and min(len(a), len(b)) >= lines.SIMILAR * max(len(a), len(b)):
            both = len(a & b)
            if both >= lines.SIMILAR * (len(a) + len(b) - both):
                edges.append((i, j))
    root = list(range(len(names)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in edges:
        root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i, x in enumerate(names):
        groups[find(i)] += places[x]
    want = {p: min(g) for g in groups.values() if len(set(g)) > 1 for p in g}
    got = {(r.doc_id, r.line): (r.group_doc, r.group_line) for r in registry.QUERIES["op2_lines"](spark, SF).collect()}
    assert not set(got) - set(want)
    assert sum(got.get(p) == g for p, g in want.items()) >= 0.97 * len(want)


def test_lines_finds_small_edits_of_short_lines(spark):
    rng = np.random.default_rng(7)
    texts = []
    for _ in range(20):
        line = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 73))
        texts += [f"<{line}>", f"<{line[:36]}#{line[37:]}>"]
    rows = lines.duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.group_doc for r in rows} == {i: i - i % 2 for i in range(len(texts))}


def test_joined_equals_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(20):
        base = set(range(100))
        sets = [{int(x) for x in rng.choice(140, rng.integers(80, 120), replace=False)} if rng.random() < 0.3 else base ^ {int(x) for x in rng.integers(0, 130, rng.integers(0, 25))} for _ in range(30)]

        def parts(edges, n=len(sets)):
            label = list(range(n))
            for a, b in edges:
                label = [label[a] if x == label[b] else x for x in label]
            return {frozenset(i for i in range(n) if label[i] == x) for x in label}

        every = [(i, j) for i, j in itertools.combinations(range(30), 2) if len(sets[i] & sets[j]) >= lines.SIMILAR * len(sets[i] | sets[j])]
        assert parts(lines.joined(sets)) == parts(every)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_simhash_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.1')}/documents.parquet").select("doc_id", "text")
    prints = [(r.doc_id, tuple(r[1:])) for r in simhash.fingerprints(docs).collect()]
    names = sorted({f for _, f in prints})
    f = np.array(names, np.int64)
    bits = np.unpackbits(f.view(np.uint8).reshape(len(f), -1), axis=1).astype(np.float32) * 2 - 1
    edges = []
    for at in range(0, len(f), 1000):
        i, j = np.nonzero(bits[at : at + 1000] @ bits.T >= bits.shape[1] - 2 * simhash.RADIUS)
        edges.append(np.stack([i + at, j])[:, i + at < j])
    a, b = np.concatenate(edges, axis=1)
    root = np.arange(len(f))
    member, leader = simhash.spanning(a, b)
    root[member] = leader
    number, groups = {x: root[i] for i, x in enumerate(names)}, collections.defaultdict(set)
    for doc, x in prints:
        groups[number[x]].add(doc)
    want = {doc: min(g) for g in groups.values() if len(g) > 1 for doc in g}
    assert {r.doc_id: r.group_id for r in simhash.groups(docs).collect()} == want


def _nearest(x, ids, queries, k=10):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = x[queries] @ x.T
    sim[np.arange(len(queries)), queries] = -9
    return {int(ids[q]): set(ids[np.argsort(-s)[:k]].tolist()) for q, s in zip(queries, sim)}


def _recall(found, want):
    got = collections.defaultdict(set)
    for r in found.collect():
        got[r.vec_id].add(r.neighbour_id)
    return sum(len(got[i] & w) for i, w in want.items()) / sum(map(len, want.values()))


def test_neighbours_recall(spark):
    path = f"{SF.replace('sf0.001', 'sf0.1')}/embeddings.parquet"
    t = pq.read_table(path).to_pydict()
    x, ids = np.array(t["embedding"], np.float32), np.array(t["vec_id"])
    df = spark.read.parquet(path)
    every = _nearest(x, ids, np.arange(len(ids)))
    asked = {i: w for i, w in every.items() if i % 100 == 0}
    found = registry.QUERIES["op7_neighbours"](spark, SF.replace("sf0.001", "sf0.1"))
    assert _recall(found, asked) >= 0.9 and {r.vec_id for r in found.select("vec_id").collect()} == set(asked)
    for per_list, search in ((256, neighbours.SEARCH), (20, 1.3)):
        assert _recall(neighbours.neighbours(df, per_list=per_list, search=search), every) >= 0.9


def test_neighbours_prune_where_vectors_cluster(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(60, 32))
    x = (centres[rng.integers(0, 60, 12000)] + 0.35 * rng.normal(size=(12000, 32))).astype(np.float32)
    x[:4000] = x[0] + 0.01 * rng.normal(size=(4000, 32))  # a third near one point
    x[4000:5000] = x[4000]  # and copies
    ids = np.arange(len(x))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    index = neighbours.Index(unit[::2], 46, neighbours.REPLICATE, 8)
    i, j = index.graph.search(unit, neighbours.REPLICATE, neighbours.COPIES)
    sizes = np.bincount(j, minlength=len(index.graph.c))
    places = np.bincount(index.place(ids[i], j), minlength=8)
    assert np.unique(i).size == len(x) and len(i) <= 1.5 * len(x) and places.max() <= 3 * places.mean()
    asked = np.arange(5000, 12000, 100)
    r, c = index.graph.search(unit[asked], neighbours.SEARCH)
    assert sizes[c].sum() / len(asked) / len(x) <= 0.1
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id bigint, embedding array<float>")
    assert _recall(neighbours.neighbours(df, df.where("vec_id >= 5000 and vec_id % 100 = 0")), _nearest(x, ids, asked)) >= 0.95


def test_graph_walk_finds_what_the_ratio_takes():
    rng = np.random.default_rng(5)
    c, q = rng.normal(size=(300, 16)).astype(np.float32), rng.normal(size=(600, 16)).astype(np.float32)
    d = np.linalg.norm(q[:, None] - c[None], axis=2)
    want = d <= d.min(1, keepdims=True) * 1.2
    got = np.zeros_like(want)
    i, j = neighbours.Graph(c).search(q, 1.2)
    got[i, j] = True
    assert len(i) == got.sum() and (got & ~(d <= d.min(1, keepdims=True) * 1.2 + 1e-3)).sum() <= 0.02 * len(i) and (got & want).sum() >= 0.95 * want.sum()
    i, j = neighbours.Graph(c).search(q, 1.2, 2)
    assert np.bincount(i, minlength=600).min() >= 1 and np.bincount(i).max() == 2


def test_viterbi_against_all_splits():
    counts, total = {"the": 50, "ring": 5, "there": 3, "in": 30, "g": 1, "her": 4, "thering": 1}, 1000

    def score(words):
        return sum(math.log(counts[w]) - math.log(total) if w in counts else math.log(10) * (1 - len(w)) - math.log(total) for w in words)

    for label in ("thering", "therein", "xthe", "zz", "ringring", "a"):
        splits = [[label[a:b] for a, b in zip((0, *cut), (*cut, len(label)))] for n in range(len(label)) for cut in itertools.combinations(range(1, len(label)), n)]
        assert math.isclose(score(urls.viterbi(label, counts, total)), max(map(score, splits)))
    assert urls.viterbi("", counts, total) == [] and urls.viterbi("x" * 500, counts, total) == ["x" * 500]


def test_url_scores_against_plain_bayes(spark):
    pages, docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("pages", "documents", "labels"))
    counts = urls.word_counts(docs)
    plain = collections.Counter(w for d in docs.collect() for w in re.findall("[a-z\x80-\U0010ffff]+", (d.text or "").lower()))
    mine = {r.word: r.n for r in counts.collect()}
    assert sum(abs(mine.get(w, 0) - n) for w, n in plain.items()) <= 0.001 * sum(plain.values())
    quality = {r.doc_id: r.quality for r in labels.collect()}
    rows = urls.url_tokens(pages, counts).collect()
    seen, marks = {0: collections.Counter(), 1: collections.Counter()}, collections.Counter()
    for r in rows:
        if r.linked in quality:
            seen[quality[r.linked]].update(r.tokens)
            marks[quality[r.linked]] += 1
    size = len(set(seen[0]) | set(seen[1])) + 1

    def weight(c, t):
        return math.log((seen[c][t] + 1) / (sum(seen[c].values()) + size))

    want = {r.page_id: math.log(marks[0] / marks[1]) + sum(weight(0, t) - weight(1, t) for t in r.tokens) for r in rows}
    got = {r.page_id: r.score for r in urls.filter_urls(pages, docs, labels).collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - s) < 1e-6 for p, s in want.items())


def test_pieces_equal_the_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for chunk in (1 << 15, 300):
        rows = sentencepieces.encode(docs, chunk=chunk).collect()
        assert len(rows) == len(texts) and all(r.round_trip for r in rows)
        assert all(list(r.ids) == lib.encode(texts[r.doc_id]) for r in rows)
    back = {r.doc_id: r.text for r in sentencepieces.decode(sentencepieces.encode(docs)).collect()}
    assert back == texts


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    taught = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    model = langid.train(taught)
    rest = langid.identify(docs.where("doc_id % 2 = 1 and length(text) > 40"), model)
    right, kept, n = rest.agg(F.avg((F.col("lang") == F.col("pred_lang")).cast("double")), F.avg((~F.col("rejected")).cast("double")), F.count("*")).first()
    assert n and right >= 0.97 and kept >= 0.95


FOREIGN = [
    "Российская академия наук опубликовала новый отчёт о состоянии климата",
    "Η κυβέρνηση ανακοίνωσε νέα μέτρα για την προστασία του περιβάλλοντος",
    "政府今天宣布了新的措施以保护环境和经济发展我们需要更多的时间",
    "Hallitus ilmoitti tänään uusista toimenpiteistä ympäristön ja talouden suojelemiseksi",
    "A kormány ma új intézkedéseket jelentett be a környezet és a gazdaság védelme érdekében",
    "xqzj vkwp zzgh qpwx jvbn kqxz wvtr pqlm zxcv bnqw rtyp ghjk vbnm qwrt zxkj",
]


def test_language_rejects_foreign_and_gibberish(spark):
    docs = spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.1')}/documents.parquet")
    model = langid.train(docs)
    assert (model.floor > 0).all()
    rows = [(i, t, None) for i, t in enumerate(FOREIGN + [" ".join([t] * 20) for t in FOREIGN] + [t[:20] for t in FOREIGN])]
    assert [r.doc_id for r in langid.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), model).where("not rejected").collect()] == []
    assert langid.identify(docs, model).agg(F.avg(F.col("rejected").cast("double"))).first()[0] <= 0.005


def test_toxicity_held_out(spark):
    sf = SF.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    tested = toxicity.classify(docs, model).withColumnRenamed("toxic", "said").join(labels.where("doc_id % 2 = 1"), "doc_id")
    hit, false = tested.agg(F.avg(F.when(F.col("toxic") == 1, F.col("said").cast("double"))), F.avg(F.when(F.col("toxic") == 0, F.col("said").cast("double")))).first()
    assert hit >= 0.9 and false <= 0.05


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now, names = docs, docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, spark.createDataFrame(stage(spark, now, SF).toArrow())
        assert now.columns == names and now.count() <= before.count()
    bench = [decontaminate.test_strings((t or "").lower().encode(), 8, 5) for t in pq.read_table(f"{SF}/benchmark.parquet")["text"].to_pylist()]
    flat = [p for ps in bench for p in ps]
    assert not [r.doc_id for r in now.collect() if any(p in decontaminate.normal(r.text.lower().encode()) for p in flat)]
    out = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in now.collect()}
    assert out.where("not round_trip").count() == 0

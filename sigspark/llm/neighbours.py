"""Approximate nearest neighbours with balanced posting lists.

Vectors are scaled to length 1. Recursive bisection of a sample at the median gives lists of
about `LIST` vectors each; their means are the centroids. A vector is stored in the list of its
nearest centroid and, near a boundary, in up to `COPIES` lists whose centroids are at most
`REPLICATE` times as far. Centroids are searched by best-first walks over a graph held in memory, and a
query reads the lists whose centroids are at most `SEARCH` times as far as the nearest.

The index is fitted on a sample of at most `SAMPLE_BYTES` of vectors, `SAMPLE` of them for each list. Where a
table would need more lists than that, lists are longer; every vector is in one, and a list is read whole.

Lists lie side by side on a line, each as long as its share of the sample, and the line is cut into
partitions: a list with many vectors, such as a third of the table near one point, is spread over several
by a hash of the id. A query goes once to each partition that holds part of one of its lists, with a bit
for each list, and streams past the members there; only the best k of each partition travel on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigspark.llm.common import Packer, exchange, mix, partitions, runs, table, unpack, unpacked, with_numbers

LIST = 256
SAMPLE, SAMPLE_BYTES = 64, 64 << 20
REPLICATE, COPIES, SEARCH = 1.005, 4, 1.15
#: Walks go on while the nearest centroid that isn't expanded is at most so many times as far as the nearest found.
WALK = 1.05
DEGREE, LONG, BEAM = 24, 8, 64
BATCH = 1024
#: Bytes of members that a task holds.
HELD = 64 << 20

FOUND = np.dtype([("key", "<i8"), ("id", "<i8"), ("sim", "<f4")])


def bisect(x: np.ndarray, leaves: int) -> list[np.ndarray]:
    """Means of balanced leaves, neighbours in the tree next to each other."""
    if leaves == 1 or len(x) < 2:
        return [x.mean(0)] if len(x) else []
    c = x[[0, len(x) // 2]]
    for _ in range(6):
        side = x @ (c[1] - c[0]) > ((c[1] ** 2).sum() - (c[0] ** 2).sum()) / 2
        if side.all() or not side.any():
            break
        c = np.stack([x[~side].mean(0), x[side].mean(0)])
    order = np.argsort(x @ (c[1] - c[0]), kind="stable")
    low = leaves // 2
    at = len(x) * low // leaves
    return bisect(x[order[:at]], low) + bisect(x[order[at:]], leaves - low)


class Graph:
    """Centroids, each linked to its nearest and to some far ones."""

    def __init__(self, centroids: np.ndarray):
        self.c = np.ascontiguousarray(centroids, np.float32)
        self.square = (self.c**2).sum(1)
        n = len(self.c)
        near = min(DEGREE, max(n - 1, 0))
        links = np.zeros((n, near), np.int32)
        for at in range(0, n, 1024):
            d = self.square - 2 * (self.c[at : at + 1024] @ self.c.T)
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            links[at : at + 1024] = np.argsort(d, axis=1, kind="stable")[:, :near]
        far = np.random.default_rng(20240613).integers(0, n, (n, min(LONG, n)), np.int32) if n else np.zeros((0, 0), np.int32)
        self.links = np.concatenate([links, far, ((np.arange(n, dtype=np.int32) + 1) % max(n, 1))[:, None]], axis=1)
        self.entries = np.unique(np.linspace(0, max(n - 1, 0), min(n, 16)).astype(np.int32))

    def search(self, q: np.ndarray, ratio: float, most: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(query, list), sorted, of the lists whose centroids are at most `ratio` times as far as the nearest; the `most` nearest unless 0."""
        found = [self._walk(q[at : at + 256], ratio, most) for at in range(0, len(q), 256)]
        rows = [i + 256 * k for k, (i, _) in enumerate(found)]
        return (np.concatenate(rows), np.concatenate([j for _, j in found])) if found else (np.zeros(0, np.int64), np.zeros(0, np.int32))

    def _walk(self, q: np.ndarray, ratio: float, most: int) -> tuple[np.ndarray, np.ndarray]:
        n, rows, own, reach = len(self.c), np.arange(len(q)), (q**2).sum(1), max(ratio, WALK)
        seen = np.zeros((len(q), n), bool)
        node = np.zeros((len(q), 0), np.int32)
        dist, closed = np.zeros((len(q), 0), np.float32), np.zeros((len(q), 0), bool)
        best = np.full(len(q), np.inf, np.float32)

        def visit(r: np.ndarray, new: np.ndarray) -> None:
            """Distances of rows r to nodes (a row of them for each) join what is held; what can't be a result any more makes room."""
            nonlocal node, dist, closed
            d = np.sqrt(np.maximum(own[r][:, None] + self.square[new] - 2 * np.matmul(self.c[new], q[r][:, :, None])[:, :, 0], 0))
            d[seen[r[:, None], new]] = np.inf
            order = np.argsort(new, axis=1, kind="stable")
            twice = np.zeros(new.shape, bool)
            np.put_along_axis(twice, order[:, 1:], np.diff(np.take_along_axis(new, order, 1), axis=1) == 0, 1)
            d[twice] = np.inf
            seen[r[:, None], new] = True
            wide = np.full((len(q), new.shape[1]), np.inf, np.float32)
            wide[r] = d
            more = np.zeros((len(q), new.shape[1]), np.int32)
            more[r] = new
            best[r] = np.minimum(best[r], d.min(1))
            node, dist, closed = np.concatenate([node, more], 1), np.concatenate([dist, wide], 1), np.concatenate([closed, np.zeros(more.shape, bool)], 1)
            useful = dist <= best[:, None] * reach + 1e-6
            keep = max(BEAM, int(useful.sum(1).max()))
            if 2 * keep < node.shape[1]:
                at = np.argpartition(np.where(useful, dist, np.inf), keep - 1, axis=1)[:, :keep]
                node, dist, closed = (np.take_along_axis(x, at, 1) for x in (node, dist, closed))

        visit(rows, np.broadcast_to(self.entries, (len(q), len(self.entries))))
        live = rows
        while len(live):
            ahead = np.where(closed[live], np.inf, dist[live])
            at = ahead.argmin(1)
            on = ahead[np.arange(len(live)), at] <= best[live] * reach + 1e-6
            live, at = live[on], at[on]
            closed[live, at] = True
            if len(live):
                visit(live, self.links[node[live, at]])
        took = dist <= best[:, None] * ratio + 1e-6
        if most:
            took &= np.argsort(np.argsort(dist, 1, "stable"), 1, "stable") < most
        i, k = np.nonzero(took)
        j = node[i, k]
        order = np.lexsort((j, i))
        return i[order], j[order]


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(n > 0, n, 1)).astype(np.float32)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return _unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim))


def best(key: np.ndarray, ids: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k most similar ids of each key, sorted; ties go to the smaller id and an id counts once."""
    order = np.lexsort((-sim, ids, key))
    a, b = key[order], ids[order]
    if len(order):
        order = order[np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]]
    order = order[np.lexsort((ids[order], -sim[order], key[order]))]
    starts, ends = runs(key[order])
    return order[np.arange(len(order)) - np.repeat(starts, ends - starts) < k]


def neighbours(vectors: DataFrame, queries: DataFrame | None = None, k: int = 10, per_list: int = LIST, replicate: float = REPLICATE, search: float = SEARCH) -> DataFrame:
    """vec_id, rank (from 1), neighbour_id, similarity (cosine, six digits): the k nearest in vectors of each of queries, or of vectors itself.

    Ties go to the smaller id. A vector is no neighbour of its own id; repeated rows count once, and
    an id with several vectors has the nearest to any of them. Rows with a null id or vector, with a
    null, infinite or NaN component, or with another dimension than most of vectors (of equally frequent
    ones, the largest counts) are left out. A zero vector has similarity 0 to all. A query whose lists hold fewer
    than k others has fewer rows. Ids of any type that can be sorted will do. Other columns are ignored; an empty
    table gives an empty result.
    """
    asked = F.struct(F.lit(True).alias("stored"), F.lit(queries is None).alias("asking"))
    rows = vectors.select("vec_id", "embedding", asked.alias("role"))
    if queries is not None:
        rows = rows.unionByName(queries.select("vec_id", "embedding", F.struct(F.lit(False).alias("stored"), F.lit(True).alias("asking")).alias("role")))
    rows = rows.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"), "role.stored", "role.asking")
    rows = rows.where(~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & (F.size("embedding") > 0))
    return with_numbers(rows, "vec_id", lambda rows: _neighbours(rows, k, per_list, replicate, search), "neighbour_id")


class Index:
    """Centroids, and where on the line of partitions each list lies."""

    def __init__(self, sample: np.ndarray, lists: int, replicate: float, parts: int):
        c = np.stack(bisect(sample, min(lists, len(sample)))) if len(sample) else np.zeros((1, sample.shape[1]), np.float32)
        _, first = np.unique(c.round(4), axis=0, return_index=True)  # equal vectors have one list
        self.graph = Graph(c[np.sort(first)])
        share = np.bincount(self.graph.search(sample[::4], replicate, COPIES)[1], minlength=len(self.graph.c)) + 1.0
        ends = np.cumsum(share) / share.sum() * parts
        self.low, self.size = np.r_[0.0, ends[:-1]], np.diff(np.r_[0.0, ends])
        self.parts = parts
        self.first = np.searchsorted(ends, np.arange(parts), "right")
        self.last = np.searchsorted(self.low, np.arange(1, parts + 1), "left")
        self.wide = -(-int((self.last - self.first).max()) // 8)

    def place(self, ids: np.ndarray, lists: np.ndarray) -> np.ndarray:
        u = mix(ids.view(np.uint64)).astype(np.float64) / 2.0**64
        return np.minimum(self.low[lists] + u * self.size[lists], self.parts - 1).astype(np.int64)


def _neighbours(rows: DataFrame, k: int, per_list: int, replicate: float, search: float) -> DataFrame:
    spark = rows.sparkSession
    schema = "vec_id bigint, rank int, neighbour_id bigint, similarity double"
    sizes = rows.where("stored").groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim, n = sizes
    rows = rows.where(F.size("embedding") == dim)
    bound = max(1024, SAMPLE_BYTES // (4 * dim))
    lists = max(1, min(n // per_list, bound // SAMPLE))
    share = min(1.0, lists * SAMPLE / n)
    chosen = rows.where("stored").where(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1 << 20)) < math.ceil(share * (1 << 20))).select("embedding").limit(2 * bound).toArrow()
    x = _matrix(chosen.column(0).combine_chunks(), dim)
    every = partitions(spark)
    index = Index(x[np.lexsort(x.T[:4])], lists, replicate, max(every, math.ceil(2.0 * n * (4 * dim + 12) / HELD)))
    sent = spark.sparkContext.broadcast(index)
    parts, wide = index.parts, index.wide
    member = np.dtype([("list", "<i4"), ("id", "<i8"), ("v", "<f4", (dim,))])
    asking = np.dtype([("id", "<i8"), ("v", "<f4", (dim,)), ("lists", "u1", (wide,))])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        stored, asked = Packer(parts), Packer(parts)

        def tag(kind: int, made: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in made:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(b.num_rows, kind, np.int32)), b.column(1)], ["part", "kind", "blob"])

        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                b = batch.slice(at, BATCH)
                ids, v = b.column(0).to_numpy(), _matrix(b.column(1), dim)
                some = np.flatnonzero(b.column(2).to_numpy(zero_copy_only=False))
                i, j = index.graph.search(v[some], replicate, COPIES)
                r = np.zeros(len(i), member)
                r["list"], r["id"], r["v"] = j, ids[some[i]], v[some[i]]
                yield from tag(0, stored.add(index.place(r["id"].copy(), j).astype(np.uint64), r))
                some = np.flatnonzero(b.column(3).to_numpy(zero_copy_only=False))
                i, j = index.graph.search(v[some], search)
                wanted = np.zeros((len(some), len(index.graph.c)), bool)
                wanted[i, j] = True
                for p in range(parts) if len(some) else ():
                    mine = wanted[:, index.first[p] : index.last[p]]
                    who = np.flatnonzero(mine.any(1))
                    r = np.zeros(len(who), asking)
                    bits = np.packbits(mine[who], axis=1)
                    r["id"], r["v"] = ids[some[who]], v[some[who]]
                    r["lists"][:, : bits.shape[1]] = bits
                    yield from tag(1, asked.add(np.full(len(who), p, np.uint64), r))
        yield from tag(0, stored.flush())
        yield from tag(1, asked.flush())

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, now, held, members = Packer(every), None, [], None
        for batch in batches:
            for part, kind, blob in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if part != now:
                    now, held, members = part, [], None
                if not kind:
                    held.append(blob)
                    continue
                if members is None:
                    m, held = unpack(held, member), []
                    m = m[np.lexsort((m["id"], m["list"]))]
                    starts, ends = runs(m["list"])
                    members = [(int(m["list"][a]), m["id"][a:b].copy(), m["v"][a:b].copy()) for a, b in zip(starts, ends)]
                    low = sent.value.first[part]
                asks = unpack([blob], asking)
                for at in range(0, len(asks), BATCH):
                    q = asks[at : at + BATCH]
                    wanted = np.unpackbits(q["lists"], axis=1).astype(bool)
                    top_id, top_sim = np.full((len(q), k), -1, np.int64), np.full((len(q), k), -9, np.float32)
                    for number, ids, v in members:
                        who = np.flatnonzero(wanted[:, number - low])
                        for a in range(0, len(ids) if len(who) else 0, 8 * BATCH):
                            near, u = ids[a : a + 8 * BATCH], v[a : a + 8 * BATCH]
                            sim = q["v"][who] @ u.T
                            sim[q["id"][who][:, None] == near[None]] = -9
                            top_id[who], top_sim[who] = _merge(top_id[who], top_sim[who], near, sim, k)
                    some = top_sim > -9
                    r = np.zeros(int(some.sum()), FOUND)
                    r["key"], r["id"], r["sim"] = np.broadcast_to(q["id"][:, None], top_id.shape)[some], top_id[some], top_sim[some]
                    yield from packer.add(mix(r["key"].view(np.uint64)), r)
        yield from packer.flush()

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in unpacked(batches, FOUND):
            r = r[best(r["key"], r["id"], r["sim"], k)]
            starts, ends = runs(r["key"])
            rank = np.arange(len(r)) - np.repeat(starts, ends - starts) + 1
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(r["key"])), pa.array(rank.astype(np.int32)), pa.array(np.ascontiguousarray(r["id"])), pa.array(np.round(r["sim"].astype(np.float64), 6))], ["vec_id", "rank", "neighbour_id", "similarity"])

    n = min(parts, every)
    met = rows.mapInArrow(spread, "part int, kind int, blob binary").repartitionById(n, (F.col("part") % n).cast("int")).sortWithinPartitions("part", "kind").select("part", "kind", "blob")
    return exchange(met.mapInArrow(answer, "part int, blob binary"), every).mapInArrow(last, schema)


def _merge(top_id: np.ndarray, top_sim: np.ndarray, ids: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best, an id once, of the best so far and of a list; ties go to the smaller id."""
    take = min(k, len(ids))
    if len(ids) > 4 * k:  # all that are at least as near as the k-th
        edge = -np.partition(-sim, take - 1, axis=1)[:, take - 1]
        edge = np.maximum(edge, top_sim[:, -1])
    else:
        edge = np.full(len(sim), -8, np.float32)
    i, j = np.nonzero((sim >= edge[:, None]) & (sim > -9))
    rows = np.r_[np.repeat(np.arange(len(sim)), k), i]
    all_id, all_sim = np.r_[top_id.ravel(), ids[j]], np.r_[top_sim.ravel(), sim[i, j]]
    keep = all_sim > -9
    rows, all_id, all_sim = rows[keep], all_id[keep], all_sim[keep]
    o = best(rows, all_id, all_sim, k)
    starts, ends = runs(rows[o])
    out_id, out_sim = np.full_like(top_id, -1), np.full_like(top_sim, -9)
    place = np.arange(len(o)) - np.repeat(starts, ends - starts)
    out_id[rows[o], place], out_sim[rows[o], place] = all_id[o], all_sim[o]
    return out_id, out_sim


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are all rows whose id is divisible by 100, against all rows."""
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours(vectors, vectors.where("vec_id % 100 = 0"))

"""Approximate nearest neighbours by a robust-pruned directed graph for each shard.

Vectors are dealt to shards by a hash of their id. A shard's graph grows in batches: a greedy beam search from the
medoid over the graph so far proposes neighbours, relaxed distance pruning (a candidate is dropped if a kept neighbour
is nearer to it by the factor alpha) keeps near but diverse edges, and reverse edges are added and pruned alike; what no
path from the medoid reaches then gets an edge from the nearest node with room for it. Graphs
are files in the shared folder; a query runs a beam search in every shard, and the shards' finds are ranked together by
exact distances in double precision. Equal vectors of a shard are one node that lists its ids: copies would cover one
another when edges are pruned, or fill all of them, and so lose each other and the rest.

Scale: a shard holds about SHARD vectors whatever the table's size, so memory and time to build one are bounded; queries
travel to the shards in blocks, and a task holds one batch of them and the mapped files of a few graphs. Ranking gathers
k finds from each shard for a query. The index covers every vector that takes part.

Defined cases: a vector that is null, empty, zero, or holds null or non-finite components takes no part; vectors are
compared with those of as many components only; rows with the query's own id are no candidates; a repeated id can stand
twice among the finds; ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.llm.common import fresh_path, in_python, local_file, saved, table, write_file
from treeline.llm.eliasfano import bundle, load

SHARD, DEGREE, BUILD_BEAM, QUERY_BEAM, ALPHA = 8192, 32, 64, 160, 1.2
BATCH, EXPAND = 256, 4
#: Tasks for each shard's queries.
PARTS = 4
#: Exact distances computed at once.
PAIRS = 1 << 16


class Graph:
    """A shard's vectors and edges; -1 stands for no edge."""

    def __init__(self, x: np.ndarray, edges: np.ndarray | None = None, start: int | None = None):
        self.x = np.ascontiguousarray(x, dtype=np.float32)
        self.norms = np.einsum("ij,ij->i", self.x, self.x)
        self.edges = np.full((len(x), DEGREE), -1, dtype=np.int32) if edges is None else edges
        self.start = int(((self.x - self.x.mean(axis=0)) ** 2).sum(axis=1).argmin()) if start is None else start

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, squared distances), nearest first, -1 beyond what was found, for each query."""
        n, rows = len(q), np.arange(len(q))
        ids = np.full((n, beam), -1, dtype=np.int32)
        dist = np.full((n, beam), np.inf, dtype=np.float32)
        open_ = np.zeros((n, beam), dtype=bool)
        seen = np.zeros((n, len(self.x)), dtype=bool)
        qn = np.einsum("ij,ij->i", q, q)
        ids[:, 0], open_[:, 0], seen[:, self.start] = self.start, True, True
        dist[:, 0] = ((q - self.x[self.start]) ** 2).sum(axis=1)
        while len(rows):
            o = open_[rows]
            rank = np.cumsum(o, axis=1)
            pick = o & (rank <= EXPAND)
            r, c = np.nonzero(pick)
            slot = rank[r, c] - 1
            chosen = np.full((len(rows), EXPAND), -1, dtype=np.int32)
            chosen[r, slot] = ids[rows[r], c]
            open_[rows[r], c] = False
            near = np.where(chosen[:, :, None] >= 0, self.edges[chosen], -1).reshape(len(rows), -1)
            near.sort(axis=1)
            new = near >= 0
            new[:, 1:] &= near[:, 1:] != near[:, :-1]
            new &= ~seen[rows[:, None], near]
            r, c = np.nonzero(new)
            seen[rows[r], near[r, c]] = True
            d = np.full(near.shape, np.inf, dtype=np.float32)
            d[r, c] = self.norms[near[r, c]] + qn[rows[r]] - 2 * np.einsum("ij,ij->i", self.x[near[r, c]], q[rows[r]])
            all_d = np.concatenate((dist[rows], d), axis=1)
            order = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
            order = np.take_along_axis(order, np.argsort(np.take_along_axis(all_d, order, 1), axis=1, kind="stable"), 1)
            dist[rows] = np.take_along_axis(all_d, order, 1)
            ids[rows] = np.take_along_axis(np.concatenate((ids[rows], np.where(new, near, -1)), axis=1), order, 1)
            now = np.take_along_axis(np.concatenate((open_[rows], new), axis=1), order, 1)
            open_[rows] = now
            rows = rows[now.any(axis=1)]
        return ids, dist

    def pruned(self, p: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """The edges of each place p among its candidates (-1: none; not p itself): nearest first, dropping those that a kept one covers."""
        out = np.full((len(p), DEGREE), -1, dtype=np.int32)
        width = candidates.shape[1]
        step = max(1, (24 << 20) // (4 * width * (width + self.x.shape[1])))
        for i in range(0, len(p), step):
            own, c = p[i : i + step], candidates[i : i + step]
            v = self.x[c]
            norms = self.norms[c]
            d = norms + self.norms[own][:, None] - 2 * np.einsum("bcd,bd->bc", v, self.x[own])
            alive = c >= 0
            d = np.where(alive, d, np.inf)
            between = norms[:, :, None] + norms[:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
            rows = np.arange(len(own))
            for k in range(DEGREE):
                j = np.where(alive, d, np.inf).argmin(axis=1)
                have = alive[rows, j]
                if not have.any():
                    break
                out[i : i + step][have, k] = c[rows, j][have]
                alive &= ALPHA**2 * between[rows, j] > d
                alive[rows, j] = False
        return out

    def insert(self, p: np.ndarray) -> None:
        ids, _ = self.search(self.x[p], BUILD_BEAM)
        self.edges[p] = self.pruned(p, np.where(ids == p[:, None], -1, ids))
        source, target = np.repeat(p, DEGREE), self.edges[p].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        places, first, counts = np.unique(target, return_index=True, return_counts=True)
        for width in (4, 16, 64, len(p)):  # places with about as many new edges together
            some = np.flatnonzero(counts <= width)
            if len(some):
                fresh = np.full((len(some), width), -1, dtype=np.int32)
                r = np.repeat(np.arange(len(some)), counts[some])
                c = np.arange(len(r)) - np.repeat(np.cumsum(counts[some]) - counts[some], counts[some])
                fresh[r, c] = source[np.repeat(first[some], counts[some]) + c]
                both = np.concatenate((self.edges[places[some]], fresh), axis=1)
                both.sort(axis=1)
                both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
                both.sort(axis=1)
                both = both[:, ::-1]
                fits = (both >= 0).sum(axis=1) <= DEGREE
                self.edges[places[some][fits]] = both[fits, :DEGREE]
                self.edges[places[some][~fits]] = self.pruned(places[some][~fits], both[~fits])
            keep = counts > width
            places, first, counts = places[keep], first[keep], counts[keep]

    @staticmethod
    def build(x: np.ndarray, seed: int = 11) -> Graph:
        g = Graph(x)
        order = np.random.default_rng(seed).permutation(len(x))
        order = order[order != g.start].astype(np.int64)
        at, size = 0, 1
        while at < len(order):
            g.insert(order[at : at + size])
            at += size
            size = min(2 * size, BATCH)
        g.connect()
        return g

    def connect(self) -> None:
        """Give each node that no path from the start reaches an edge from the nearest found one that has room for it, widening the edges where none has."""
        reached = np.zeros(len(self.x), dtype=bool)

        def spread(now: np.ndarray) -> None:
            while len(now):
                reached[now] = True
                now = np.unique(self.edges[now])
                now = now[now >= 0]
                now = now[~reached[now]]

        spread(np.array([self.start]))
        while len(missing := np.flatnonzero(~reached)[:BATCH]):
            found, _ = self.search(self.x[missing], min(BUILD_BEAM, len(self.x)))
            for node, near in zip(missing, found):
                if not reached[node]:
                    near = near[near >= 0]
                    room = (self.edges[near] < 0).any(axis=1)
                    if not room.any():
                        self.edges = np.concatenate((self.edges, np.full((len(self.x), 1), -1, dtype=np.int32)), axis=1)
                        room[:] = True
                    at = near[room.argmax()]
                    self.edges[at, (self.edges[at] < 0).argmax()] = node
                    spread(np.array([node]))


def usable(embedding: Column) -> Column:
    sound = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & F.coalesce(sound, F.lit(False)) & F.coalesce(F.exists(embedding, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of its vector, and the first row of each vector; numbers in the order of first rows."""
    whole = np.ascontiguousarray(x + x.dtype.type(0))  # -0.0 becomes 0.0
    _, first, number = np.unique(whole.view(np.dtype((np.void, whole.itemsize * whole.shape[1]))).ravel(), return_index=True, return_inverse=True)
    order = np.argsort(first)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    return place[number.ravel()], first[order]


def _offsets(numbers: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(np.bincount(numbers)))).astype(np.int64)


def _spread(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, place): counts[i] places from first[i] on, for each i."""
    i = np.repeat(np.arange(len(counts)), counts)
    return i, first[i] + np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts)


def grouped(v: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
    """Rows in the order of v, equal ones together: the vectors x, their ids (those of x[i] are ids[at[i]:at[i + 1]]), and in nodes the ranges of vectors that are equal in single precision."""
    vector, first = _distinct(x)
    node, _ = _distinct(x[first].astype(np.float32))
    order = np.argsort(node, kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    vector = place[vector]
    return {"ids": v[np.argsort(vector, kind="stable")], "at": _offsets(vector), "x": x[first[order]], "nodes": _offsets(node)}


def _write_graphs(folder: str):
    def run(batches):
        ids: dict[tuple, list] = {}
        vectors: dict[tuple, list] = {}
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("dim", "shard")], axis=1)
            for key in np.unique(keys, axis=0).tolist():
                part = batch.filter(pa.array((keys == key).all(axis=1)))
                ids.setdefault(tuple(key), []).append(part.column("vec_id").to_numpy())
                vectors.setdefault(tuple(key), []).append(_matrix(part.column("embedding")))
        for key in ids:
            v, x = np.concatenate(ids[key]), np.concatenate(vectors.pop(key))
            order = np.argsort(v, kind="stable")
            parts = grouped(v[order], x[order])
            g = Graph.build(parts["x"][parts["nodes"][:-1]])
            path = f"{folder}/graph-{key[0]}-{key[1]}.bin"
            write_file(path, bundle({**parts, "edges": g.edges, "start": np.array([g.start])}))
            yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([path])], names=["dim", "shard", "path"])

    return run


def build_index(vectors: DataFrame, shard: int = SHARD) -> DataFrame:
    """Write a graph for each shard of vectors (vec_id, embedding); the rows (dim, shard, path) of the graphs."""
    vectors = vectors.filter(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.size("embedding").alias("dim"))
    n = vectors.count()
    shards = max(1, math.ceil(n / shard))
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    folder = fresh_path(vectors.sparkSession, "graphs")
    return saved(in_python(dealt.repartition(8 * shards, "dim", "shard"), _write_graphs(folder), "dim int, shard long, path string"), "graphs")


_GRAPHS: dict[str, tuple] = {}


def _open(path: str) -> tuple:
    if path not in _GRAPHS:
        if len(_GRAPHS) >= 8:
            _GRAPHS.pop(next(iter(_GRAPHS)))
        f = load(local_file(path))
        _GRAPHS[path] = (Graph(f["x"][f["nodes"][:-1]], f["edges"], int(f["start"][0])), Members(f["ids"], f["at"], f["x"], f["nodes"]))
    return _GRAPHS[path]


class Members:
    """The rows behind a graph's nodes."""

    def __init__(self, ids: np.ndarray, at: np.ndarray, x: np.ndarray, nodes: np.ndarray):
        self.ids, self.at, self.x, self.nodes = ids, at, x, nodes
        self.names, rank = np.unique(ids, return_inverse=True)
        self.keys = np.repeat(np.arange(len(x)), np.diff(at)) * (len(self.names) + 1) + rank.ravel()

    def nearest(self, found: np.ndarray, q: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in q, id, distance) of the k nearest rows of the nodes found for each query, smaller ids first among equal ones, own ids left out."""
        r, c = np.nonzero(found >= 0)
        node = found[r, c]
        i, one = _spread(self.nodes[node], self.nodes[node + 1] - self.nodes[node])
        r = r[i]
        score = np.empty(len(r))
        for j in range(0, len(r), PAIRS):
            diff = self.x[one[j : j + PAIRS]].astype(np.float64) - q[r[j : j + PAIRS]].astype(np.float64)
            score[j : j + PAIRS] = np.sqrt(np.einsum("bd,bd->b", diff, diff))
        # A vector's ids are sorted: those equal to the query's own are a run, which is stepped over.
        rank = np.searchsorted(self.names, own)
        rank[self.names[np.minimum(rank, len(self.names) - 1)] != own] = len(self.names)
        key = one * (len(self.names) + 1) + rank[r]
        low, high = np.searchsorted(self.keys, key), np.searchsorted(self.keys, key, side="right")
        i, place = _spread(self.at[one], np.minimum(self.at[one + 1] - self.at[one] - (high - low), k))
        ids = self.ids[place + np.where(place >= low[i], (high - low)[i], 0)]
        r, score = r[i], score[i]
        order = np.lexsort((ids, score, r))
        order = order[np.arange(len(order)) - np.searchsorted(r[order], r[order]) < k]
        return r[order], ids[order], score[order]


def _ask(k: int, beam: int):
    def run(batches):
        for batch in batches:
            paths = np.array(batch.column("path").to_pylist())
            for path in dict.fromkeys(paths.tolist()):
                part = batch.filter(pa.array(paths == path))
                g, members = _open(path)
                query, q = part.column("query_id").to_numpy(), _matrix(part.column("embedding"))
                for i in range(0, len(q), BATCH):
                    found, _ = g.search(q[i : i + BATCH].astype(np.float32), min(beam, len(g.x)))
                    r, names, score = members.nearest(found, q[i : i + BATCH], query[i : i + BATCH], k)
                    yield pa.RecordBatch.from_arrays([pa.array(query[i : i + BATCH][r]), pa.array(names), pa.array(score)], names=["query_id", "vec_id", "score"])

    return run


def nearest(queries: DataFrame, index: DataFrame, k: int = 10, beam: int = QUERY_BEAM) -> DataFrame:
    """query_id, rank, vec_id and score (distance) of the k nearest found for each row of queries (query_id, embedding)."""
    q = queries.filter(usable(F.col("embedding"))).select(F.col("query_id").cast("long").alias("query_id"), "embedding", F.size("embedding").alias("dim"))
    # a fixed number of tasks for each shard, which the adaptive plan can't merge into one
    asked = q.join(index, "dim").repartition(PARTS * max(1, index.count()), "path", F.pmod(F.xxhash64("query_id"), F.lit(PARTS))).sortWithinPartitions("path", "query_id")
    found = in_python(asked.select("query_id", "embedding", "path"), _ask(k, beam), "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), build_index(vectors))

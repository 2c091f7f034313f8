"""Graph indexes, HNSW and satellite-system graphs: one graph for each shard, all shards searched.

A shard is a bounded number of vectors, so graphs stay in a task's memory at any size of the
collection; a search asks every shard and merges. Graphs are built once, and stored as rows of a
table; queries are a distributed table, of which every shard is sent all, in parts.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..scratch import written
from .vector_index import RESULT, best, cores_of, meet, packed, part_of, parts_for, valid_queries

SHARD_ROWS = 50_000
#: Points that are compared with a shard at a time, and edges that are measured at a time.
STEP, EDGES = 256, 1 << 16


def _d(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return ((x - q) ** 2).sum(axis=1)


def beam(vectors_: np.ndarray, links: np.ndarray, q: np.ndarray, entry: list[int], width: int, allowed: np.ndarray | None = None) -> list[tuple[float, int]]:
    """Best-first search on one layer: the width nearest found, nearest first. links rows end in -1.

    Points that allowed leaves out lead on to others, but are not found and do not end the search.
    """
    seen = set(entry)
    todo = [(float(d), e) for d, e in zip(_d(q, vectors_[entry]), entry)]
    found = [(-d, e) for d, e in todo if allowed is None or allowed[e]]
    heapq.heapify(todo)
    heapq.heapify(found)
    while todo:
        d, at = heapq.heappop(todo)
        if len(found) >= width and d > -found[0][0]:
            break
        near = [j for j in links[at].tolist() if j >= 0 and j not in seen]
        if not near:
            continue
        seen.update(near)
        for dj, j in zip(_d(q, vectors_[near]).tolist(), near):
            if len(found) < width or dj < -found[0][0]:
                heapq.heappush(todo, (dj, j))
                if allowed is None or allowed[j]:
                    heapq.heappush(found, (-dj, j))
                    if len(found) > width:
                        heapq.heappop(found)
    return sorted((-d, j) for d, j in found)


def diverse(vectors_: np.ndarray, candidates: list[tuple[float, int]], m: int) -> list[int]:
    """At most m neighbours, each nearer to the point than to any neighbour chosen before, then the nearest left."""
    kept: list[int] = []
    spare: list[int] = []
    for d, j in candidates:
        if len(kept) >= m:
            break
        if not kept or (_d(vectors_[j], vectors_[kept]) > d).all():
            kept.append(j)
        else:
            spare.append(j)
    return (kept + spare)[:m]


def _before(x: np.ndarray, ef: int):
    """(from, ids, distances) in blocks of points: the ef nearest, nearest first, of the points before each; -1 and infinity where there are fewer."""
    norms = (x**2).sum(axis=1)
    for lo in range(0, len(x), STEP):
        hi = min(lo + STEP, len(x))
        d = norms[lo:hi, None] - 2 * x[lo:hi] @ x[:hi].T + norms[:hi]
        d[np.arange(lo, hi)[:, None] <= np.arange(hi)] = np.inf
        at = np.argpartition(d, ef - 1, axis=1)[:, :ef] if hi > ef else np.broadcast_to(np.arange(hi), d.shape)
        near = np.take_along_axis(d, at, axis=1)
        order = np.argsort(near, axis=1, kind="stable")
        near = np.maximum(np.take_along_axis(near, order, axis=1), 0)
        yield lo, np.where(np.isfinite(near), np.take_along_axis(at, order, axis=1), -1), near


def _diverse(x: np.ndarray, ids: np.ndarray, dist: np.ndarray, m: int) -> np.ndarray:
    """diverse() of many points at a time: by row at most m of the candidates ids (nearest first, -1: none), -1 behind them."""
    out = np.full((len(ids), m), -1, np.int64)
    for lo in range(0, len(ids), STEP // 2):
        own, d = ids[lo : lo + STEP // 2], dist[lo : lo + STEP // 2]
        v = x[np.maximum(own, 0)]
        length = (v * v).sum(axis=2)
        apart = length[:, :, None] - 2 * v @ v.transpose(0, 2, 1) + length[:, None, :]
        kept, count = np.zeros(own.shape, bool), np.zeros(len(own), int)
        for c in range(own.shape[1]):
            close = (kept[:, :c] & (apart[:, c, :c] <= d[:, c, None])).any(axis=1)
            kept[:, c] = (own[:, c] >= 0) & (count < m) & ~close
            count += kept[:, c]
        # kept ones first, then the nearest left, in the order of distance
        order = np.argsort(np.where(own < 0, 2, ~kept), axis=1, kind="stable")[:, :m]
        found = np.take_along_axis(own, order, axis=1)
        out[lo : lo + STEP // 2, : found.shape[1]] = found
    return out


def _linked(x: np.ndarray, m: int, ef: int, room: int) -> np.ndarray:
    """The edges of one layer: of each point at most room neighbours, -1 behind them."""
    n = len(x)
    forward = np.full((n, m), -1, np.int64)
    for lo, at, near in _before(x, ef):
        forward[lo : lo + len(at)] = _diverse(x, at, near, m)
    a, slot = np.nonzero(forward >= 0)
    b = forward[a, slot]
    a, b = np.concatenate([a, b]), np.concatenate([b, a])  # there and back
    d = np.concatenate([((x[a[lo : lo + EDGES]] - x[b[lo : lo + EDGES]]) ** 2).sum(axis=1) for lo in range(0, len(a), EDGES)] or [np.zeros(0)])
    order = np.lexsort((b, d, a))
    a, b, d = a[order], b[order], d[order]
    size = np.bincount(a, minlength=n)
    place = np.arange(len(a)) - np.repeat(np.cumsum(size) - size, size)
    out = np.full((n, room), -1, np.int64)
    fits = size[a] <= room
    out[a[fits], place[fits]] = b[fits]
    full, width = np.flatnonzero(size > room), 4 * room
    if len(full):  # too many edges: the nearest of them, pruned
        row = np.full(n, -1)
        row[full] = np.arange(len(full))
        take = (row[a] >= 0) & (place < width)
        ids, dist = np.full((len(full), width), -1, np.int64), np.full((len(full), width), np.inf)
        ids[row[a[take]], place[take]], dist[row[a[take]], place[take]] = b[take], d[take]
        out[full] = _diverse(x, ids, dist, room)
    return out


class Hnsw:
    """A hierarchical navigable small world of one shard."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, layers: list[np.ndarray], entry: int):
        self.ids, self.x, self.layers, self.entry = ids, x, layers, entry

    @classmethod
    def build(cls, ids: np.ndarray, x: np.ndarray, m: int = 16, ef: int = 64, seed: int = 3) -> Hnsw:
        """On each layer every point is linked to m of the ef nearest among the points before it, and those back to it.

        The ef nearest are found by matrix products, which for a shard take less time than walks;
        edges are pruned once all are known.
        """
        rng, n = np.random.default_rng(seed), len(x)
        level = np.minimum((-np.log(rng.random(n)) / np.log(m)).astype(int), 8)
        layers = []
        for h in range(int(level.max(initial=0)) + 1):
            own, room = np.flatnonzero(level >= h), 2 * m if h == 0 else m
            table = np.full((n, room), -1, np.int32)
            linked = _linked(x[own], m, ef, room)
            table[own] = np.where(linked >= 0, own[linked], -1)
            layers.append(table)
        return cls(ids, x, layers, int(level.argmax()) if n else 0)

    def search(self, q: np.ndarray, k: int, ef: int, allowed: np.ndarray | None = None) -> list[tuple[float, int]]:
        if not len(self.x):
            return []
        if allowed is not None and allowed.sum() <= 4 * max(k, ef):  # so few are compared faster than found
            return self.compare(q[None], k, np.flatnonzero(allowed))[0]
        at = [self.entry]
        for h in range(len(self.layers) - 1, 0, -1):
            at = [beam(self.x, self.layers[h], q, at, 1)[0][1]]
        return beam(self.x, self.layers[0], q, at, max(k, ef), allowed)[:k]

    def compare(self, q: np.ndarray, k: int, own: np.ndarray) -> list[list[tuple[float, int]]]:
        """For each of several queries the k nearest of some points, exactly; a point's distance is that of a walk."""
        out, x = [], self.x[own]
        norms = (x * x).sum(axis=1)
        for lo in range(0, len(q), STEP):
            d = norms - 2 * q[lo : lo + STEP] @ x.T
            more = min(len(own), 2 * k)  # products are rounded otherwise: a few more are measured again
            near = np.argpartition(d, more - 1, axis=1)[:, :more] if more else np.zeros((len(d), 0), int)
            for v, j in zip(q[lo : lo + STEP], near):
                at = own[j]
                e = _d(v, self.x[at])
                out.append([(float(e[i]), int(at[i])) for i in np.lexsort((at, e))[:k]])
        return out

    def search_all(self, q: np.ndarray, k: int, ef: int, allowed: np.ndarray | None = None):
        """search() of several queries. Where most points are left out a walk passes many for each that it finds: all that are allowed are then compared."""
        if allowed is not None and 2 * allowed.sum() < len(allowed):
            return self.compare(q, k, np.flatnonzero(allowed))
        return (self.search(v, k, ef, allowed) for v in q)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, x=self.x, entry=self.entry, **{f"l{h}": a for h, a in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Hnsw:
        z = np.load(io.BytesIO(raw))
        return cls(z["ids"], z["x"], [z[f"l{h}"] for h in range(sum(n[0] == "l" for n in z.files))], int(z["entry"]))


class Ssg(Hnsw):
    """A satellite-system graph of one shard: neighbours of neighbours, pruned so that kept edges spread by an angle."""

    @classmethod
    def build(cls, ids: np.ndarray, x: np.ndarray, m: int = 24, ef: int = 100, seed: int = 3, near: int = 20, angle: float = 60.0, roots: int = 8) -> Ssg:
        n = len(x)
        near = min(near, max(0, n - 1))
        knn = np.zeros((n, near), np.int32)
        norms = (x**2).sum(1)
        for lo in range(0, n, STEP):
            d = norms[lo : lo + STEP, None] - 2 * x[lo : lo + STEP] @ x.T + norms
            d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
            if near:
                at = np.argpartition(d, near - 1, axis=1)[:, :near]
                knn[lo : lo + STEP] = np.take_along_axis(at, np.argsort(np.take_along_axis(d, at, axis=1), axis=1, kind="stable"), axis=1)
        cos = np.cos(np.radians(angle))
        out: list[list[int]] = []
        for lo in range(0, n, STEP // 4):
            own = np.arange(lo, min(lo + STEP // 4, n))
            pool = np.sort(np.concatenate([knn[own], knn[knn[own]].reshape(len(own), near * near)], axis=1), axis=1)
            way = x[pool] - x[own, None]
            length = np.sqrt((way**2).sum(2))
            again = np.zeros(pool.shape, bool)
            again[:, 1:] = pool[:, 1:] == pool[:, :-1]
            order = np.argsort(np.where(again | (pool == own[:, None]), np.inf, length), axis=1, kind="stable")[:, :ef]
            away = ~np.take_along_axis(again | (pool == own[:, None]), order, axis=1)
            pool, length, way = np.take_along_axis(pool, order, axis=1), np.take_along_axis(length, order, axis=1), np.take_along_axis(way, order[:, :, None], axis=1)
            narrow = way @ way.transpose(0, 2, 1) > cos * length[:, :, None] * length[:, None, :]
            kept, count = np.zeros(pool.shape, bool), np.zeros(len(own), int)
            for c in range(pool.shape[1]):
                kept[:, c] = away[:, c] & (count < m) & ((length[:, c] == 0) | ~(kept[:, :c] & narrow[:, c, :c]).any(axis=1))
                count += kept[:, c]
            out += [p[k].tolist() for p, k in zip(pool, kept)]
        for i in range(n):  # edges back, while there is room
            for j in list(out[i]):
                if i not in out[j] and len(out[j]) < m:
                    out[j].append(i)
        rng = np.random.default_rng(seed)
        root = [int(((x - x.mean(0)) ** 2).sum(1).argmin()), *rng.permutation(n)[: roots - 1].tolist()] if n else [0]
        # what the first root does not reach is hung on its nearest reached point
        links = [list(map(int, o)) for o in out]
        reached = np.zeros(n, bool)
        todo = [root[0]] if n else []
        while True:
            while todo:
                at = todo.pop()
                if not reached[at]:
                    reached[at] = True
                    todo += [j for j in links[at] if not reached[j]]
            left = np.flatnonzero(~reached)
            if not len(left):
                break
            here = np.flatnonzero(reached)
            links[int(here[_d(x[left[0]], x[here]).argmin()])].append(int(left[0]))
            todo = [int(left[0])]
        width = max(map(len, links), default=1) or 1
        table = np.full((n, width), -1, np.int32)
        for i, o in enumerate(links):
            table[i, : len(o)] = o
        return cls(ids, x, [table], root[0])


KINDS = {"hnsw": Hnsw, "ssg": Ssg}


class GraphIndex:
    """Sharded graphs as a table (shard, shards, graph)."""

    def __init__(self, graphs: DataFrame, kind: str = "hnsw"):
        self.graphs, self.kind = graphs, kind

    @classmethod
    def build(cls, df: DataFrame, id_col: str = "_id", vector_col: str = "vector", kind: str = "hnsw", shard_rows: int = SHARD_ROWS, path: str | None = None, **parameters) -> GraphIndex:
        """The graphs are built once and written, to path or to the shared folder."""
        maker = KINDS[kind]
        rows = df.select(F.col(id_col).cast("bigint").alias("_id"), F.col(vector_col).cast("array<double>").alias("v")).filter(vectors.is_valid(F.col("v")))
        shards = max(1, -(-rows.count() // shard_rows))

        def one(table: pa.Table) -> pa.Table:
            table = table.sort_by("_id").combine_chunks()
            x = np.asarray(table["v"].combine_chunks().flatten()).reshape(table.num_rows, -1)
            graph = maker.build(table["_id"].to_numpy(), x, **parameters)
            return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int32()), "shards": pa.array([shards], pa.int32()), "graph": pa.array([graph.dump()], pa.binary())})

        sharded = rows.withColumn("shard", _shard(F.lit(shards)))
        made = sharded.groupBy("shard").applyInArrow(one, "shard int, shards int, graph binary")
        if path is None:
            return cls(written(made, "graph"), kind)
        made.write.mode("overwrite").parquet(path)
        return cls.load(df.sparkSession, path, kind)

    def search(self, queries: DataFrame, k: int, ef: int = 100, allowed: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
        """allowed: the _ids that may be found; deleted: those that may not. Both work inside the walk: points left out still lead on."""
        maker, width = KINDS[self.kind], max(k, ef)
        shards = [r[0] for r in self.graphs.select("shard").distinct().collect()]
        if not shards:
            return queries.sparkSession.createDataFrame([], RESULT + ", rank int")
        total = self.graphs.select("shards").first()[0]
        valid = valid_queries(queries)
        parts = max(parts_for(queries, len(shards), len(shards)), -(-2 * cores_of(queries) // len(shards)))
        each = valid.withColumn("cell", F.explode(F.array(*map(F.lit, shards)).cast("array<int>")))
        asks = packed(each.select(part_of(parts), "cell", "_id", "v", F.lit(None).alias("more")))
        keep = allowed is not None
        listed = allowed.select("_id") if keep else None
        if deleted is not None:
            listed = listed.join(deleted.select("_id"), "_id", "left_anti") if keep else deleted.select("_id")

        def walk(near, shard, q, ids, raw, more):
            g = maker.load(raw)
            mask = None if listed_none else np.isin(g.ids, np.frombuffer(more, np.int64)) == keep
            if mask is not None and not mask.any():
                return
            if q.shape[1] != g.x.shape[1]:
                return
            for lo in range(0, len(q), STEP):
                row, found = [], []
                for at, own in enumerate(g.search_all(q[lo : lo + STEP], k, width, mask), lo):
                    row += [at] * len(own)
                    found += own
                if found:
                    d, j = map(np.array, zip(*found))
                    near.take(np.array(row), g.ids[j], d)

        listed_none, data = listed is None, self.graphs.select(F.col("shard").cast("bigint").alias("cell"), F.lit(None).cast("binary").alias("ids"), F.col("graph").alias("vectors"))
        if listed_none:
            data = data.withColumn("more", F.lit(None).cast("binary"))
        else:
            # the ids go to their shard, of which there are no more than a shard holds
            own = listed.select(F.col("_id").cast("bigint").alias("_id")).distinct().select(_shard(F.lit(total)).cast("bigint").alias("cell"), "_id")
            data = data.join(own.groupBy("cell").agg(F.collect_list("_id").alias("listed")), "cell", "left").mapInArrow(_ids_as_bytes, "cell bigint, ids binary, vectors binary, more binary")
        return best(meet(asks, data.withColumn("part", F.lit(0)), parts, parts * len(shards), k, walk), k)

    def save(self, path: str) -> None:
        self.graphs.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str, kind: str = "hnsw") -> GraphIndex:
        return cls(spark.read.parquet(path), kind)


def _shard(shards):
    return F.pmod(F.xxhash64("_id"), shards).cast("int")


def _ids_as_bytes(batches):
    for b in batches:
        more = [np.array(x or [], np.int64).tobytes() for x in b.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(more, pa.binary())], ["cell", "ids", "vectors", "more"])

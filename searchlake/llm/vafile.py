"""Exact nearest neighbours by vector-approximation files.

Vectors are stored once as small codes, one for each dimension, and once exactly. A search scans
the codes of all vectors for lower and upper bounds of distances; only vectors whose lower bound
does not exceed the k-th least upper bound are candidates, and their exact vectors are read in
the order of their lower bounds: the first ones settle the k-th distance, and of the rest only
those whose lower bound can beat it are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Scratch, map_arrow

#: Neighbours, bits of a code, vectors in a block, queries in a part, and candidates that a task keeps before it hands them on.
K, BITS, BLOCK, QUERIES, HELD = 10, 8, 4096, 1024, 1 << 20
#: Scaled distances that differ by less are ties, as they are rounded to nine digits.
TIE = 2e-9
RESULT = "query_id bigint, rank int, vec_id bigint, distance double"


class Codes:
    """The quantiser of a table: for each dimension equal cells between its ends. Vectors are scaled by a power of two into [-1, 1], which is exact."""

    def __init__(self, low: np.ndarray, high: np.ndarray, bits: int = BITS):
        top = float(max(np.abs(low).max(initial=0), np.abs(high).max(initial=0)))
        self.power = int(np.frexp(top)[1]) if top > 0 else 0
        self.cells, self.low = 1 << bits, self.scaled(low)
        high = self.scaled(high)
        self.step = np.where(high > self.low, (high - self.low) / self.cells, 1.0)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.ldexp(np.asarray(x, np.float64), -self.power)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes of scaled vectors, a byte each."""
        return np.clip((x - self.low) / self.step, 0, self.cells - 1).astype(np.uint8)

    def centres(self, codes: np.ndarray) -> np.ndarray:
        return self.low + (codes + 0.5) * self.step

    def radius(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """How far each scaled vector is from the centre of its cell, rounded up."""
        return np.nextafter((np.sqrt(((x - self.centres(codes)) ** 2).sum(axis=1)) * (1 + 1e-9)).astype(np.float32), np.float32(np.inf))

    def bounds(self, q: np.ndarray, codes: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of the distances from scaled queries, from codes alone."""
        c = self.centres(codes)
        qq, cc = (q * q).sum(axis=1)[:, None], (c * c).sum(axis=1)
        square = qq - 2 * (q @ c.T) + cc
        slack = 1e-15 * (q.shape[1] + 8) * (qq + cc)  # more than the rounding of the sums
        return np.sqrt(np.maximum(0, square - slack)) - radius, np.sqrt(np.maximum(0, square + slack)) + radius


def candidates(codes: Codes, q_ids: np.ndarray, q: np.ndarray, blocks: Iterator[tuple], k: int, held: int = HELD) -> Iterator[tuple]:
    """(query number, block, position, lower, upper) arrays of what may be among the k nearest of the blocks (block, ids, codes, radius).

    limit is, for each query, the k-th least upper bound so far; it only falls, so what exceeds it is no candidate.
    """
    limit, best = np.full(len(q), np.inf), np.full((len(q), k), np.inf)
    kept, n = [], 0

    def done():
        row, block, pos, lower, upper = (np.concatenate(x) for x in zip(*kept))
        own = lower <= limit[row] + TIE
        return row[own], block[own], pos[own], lower[own], upper[own]

    for block, ids, code, radius in blocks:
        for lo in range(0, len(q), 256):
            rows = slice(lo, lo + 256)
            lower, upper = codes.bounds(q[rows], code, radius)
            own = q_ids[rows][:, None] == ids
            lower[own] = upper[own] = np.inf  # rows of the query's own id are no neighbours
            least = np.partition(upper, k - 1, axis=1)[:, :k] if upper.shape[1] > k else upper
            best[rows] = np.sort(np.concatenate([best[rows], least], axis=1), axis=1)[:, :k]
            limit[rows] = best[rows, k - 1]
            row, pos = np.nonzero((lower <= limit[rows][:, None] + TIE) & (lower < np.inf))
            kept.append((row + lo, np.full(len(row), block), pos, lower[row, pos], upper[row, pos]))
            n += len(row)
        if n > held:  # what is left after pruning stays, unless it is too much
            kept = [done()]
            n = len(kept[0][0])
            if n > held // 2:
                yield kept[0]
                kept, n = [], 0
    if kept:
        yield done()


def _usable(vectors: DataFrame) -> DataFrame:
    kind = "float" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "double"
    good = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    return good.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))))


def _array(batch, column: int, dim: int) -> np.ndarray:
    return np.asarray(batch.column(column).flatten(), np.float64).reshape(-1, dim)


def nearest(vectors: DataFrame, k: int = K, block_rows: int = BLOCK, bits: int = BITS, queries: Column | None = None, counts: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, distance): for the rows that the condition queries picks, or all, the k nearest others by Euclidean distance, exactly.

    Ties go to the smaller vec_id, by distances to nine digits of the table's largest number. Rows with a null id, a null or empty vector, or a null,
    infinite or NaN element are neither queries nor answers; of several dimensions the commonest
    (of those the largest) counts. Rows of equal vec_id are no neighbours of each other, but each
    is searched and found. Fewer than k others give fewer rows; an empty table gives none. Of many
    equal vectors only those of the smallest ids can be answers, and only they are stored. Other
    columns, of whatever name, are not looked at. Codes go to every part of the queries, exact
    vectors are read for candidates only; counts, where given, gets how many there were of each.
    """
    spark = vectors.sparkSession
    scratch, good = Scratch(spark, "va"), _usable(vectors)
    sizes = good.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if sizes is None:
        return spark.createDataFrame([], RESULT)
    dim, n = sizes
    kind = np.float32 if isinstance(good.schema["v"].dataType.elementType, T.FloatType) else np.float64
    good = good.filter(F.size("v") == dim)

    def ends(batch):
        v = _array(batch, 0, dim)
        yield pa.RecordBatch.from_arrays([pa.array([v.min(axis=0).tolist()]), pa.array([v.max(axis=0).tolist()])], ["low", "high"])

    found = map_arrow(good.select("v"), ends, "low array<double>, high array<double>")
    found = found.select(F.posexplode(F.arrays_zip("low", "high"))).groupBy("pos").agg(F.min("col.low"), F.max("col.high")).orderBy("pos").collect()
    codes = Codes(np.array([r[1] for r in found]), np.array([r[2] for r in found]), bits)

    # of equal vectors at most k of one id and 2k in all: a query drops those of its own id, and k are left
    one = Window.partitionBy("v", "vec_id").orderBy(F.lit(0))
    few = good.withColumn("r", F.row_number().over(one)).filter(F.col("r") <= k).drop("r")
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("r") <= 2 * k).drop("r")

    def stored(batches):
        def rows(ids, v, number):
            x = codes.scaled(v)
            code = codes.encode(x)
            cols = [[number], [ids.tobytes()], [code.tobytes()], [codes.radius(x, code).tobytes()], [v.astype(kind).tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["number", "ids", "codes", "radius", "vectors"])

        held, size, number = [], 0, 0
        for b in batches:
            if b.num_rows:
                held.append((b.column(0).to_numpy(), _array(b, 1, dim)))
                size += b.num_rows
            while size >= block_rows:
                ids, v = (np.concatenate(x) for x in zip(*held))
                yield rows(ids[:block_rows], v[:block_rows], number)
                held, size, number = [(ids[block_rows:], v[block_rows:])], size - block_rows, number + 1
        if size:
            yield rows(*(np.concatenate(x) for x in zip(*held)), number)

    # the approximation file: a row for each block; readers of codes never touch the vectors' column
    blocks = few.mapInArrow(stored, "number bigint, ids binary, codes binary, radius binary, vectors binary")
    blocks = scratch.save(blocks.withColumn("block", F.monotonically_increasing_id()).drop("number"))
    asked = (good if queries is None else _usable(vectors.filter(queries)).filter(F.size("v") == dim)).groupBy("vec_id", "v").agg(F.count("*").alias("copies"))
    asked = scratch.save(asked.withColumn("q", F.monotonically_increasing_id()))
    n_asked, n_blocks = asked.count(), blocks.count()
    if not n_asked or not n_blocks:
        return spark.createDataFrame([], RESULT)
    # every part of the queries meets every block of codes; blocks in groups, so that all cores have work
    cores = spark.sparkContext.defaultParallelism
    parts = -(-n_asked // QUERIES)
    groups = min(n_blocks, max(1, -(-2 * cores // parts)))

    def gather(batches):
        for b in batches:
            if b.num_rows:
                part, order = b.column(0).to_numpy(), np.argsort(b.column(0).to_numpy(), kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                    at = pa.array(own)
                    v = np.asarray(b.column(3).take(at).flatten(), np.float64)
                    cols = [b.column(1).take(at).to_numpy(), b.column(2).take(at).to_numpy()]
                    yield pa.RecordBatch.from_arrays([pa.array(part[own[:1]]), *(pa.array([c.tobytes()], pa.binary()) for c in (*cols, v))], ["part", "a", "b", "c"])

    part = F.pmod(F.xxhash64("q"), F.lit(parts)).cast("int").alias("part")
    packs = asked.select(part, "q", "vec_id", "v").mapInArrow(gather, "part int, a binary, b binary, c binary")
    packs = packs.select("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(0).alias("kind"), F.lit(-1).cast("bigint").alias("block"), "a", "b", "c")
    data = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.pmod("block", F.lit(groups)).cast("int").alias("group"), F.lit(1).alias("kind"), "block", F.col("ids").alias("a"), F.col("codes").alias("b"), F.col("radius").alias("c"))

    def scan(batches):
        def answers(task):
            if task is None:
                return
            held, rest = [], iter(task)
            first = None
            for r in rest:
                if r[0]:
                    first = r
                    break
                held.append(r[2:])
            if not held or first is None:
                return
            number, ids, q = (np.concatenate([np.frombuffer(h[j], t) for h in held]) for j, t in enumerate((np.int64, np.int64, np.float64)))
            q = codes.scaled(q.reshape(-1, dim))

            def each():
                r = first
                while r is not None:
                    i = np.frombuffer(r[2], np.int64)
                    yield r[1], i, np.frombuffer(r[3], np.uint8).reshape(len(i), dim), np.frombuffer(r[4], np.float32)
                    r = next(rest, None)

            for row, block, pos, lower, upper in candidates(codes, ids, q, each(), k):
                yield pa.RecordBatch.from_arrays([pa.array(number[row]), pa.array(block, pa.int64()), pa.array(pos, pa.int32()), pa.array(lower), pa.array(upper)], ["q", "block", "pos", "lower", "upper"])

        def tasks():
            """The rows, one run of them for each (part, group)."""
            for b in batches:
                for r in range(b.num_rows):
                    yield tuple(b.column(c)[r].as_py() for c in range(7))

        rows, ahead = tasks(), []

        def run(key):
            while ahead and ahead[0][:2] == key:
                yield ahead.pop()[2:]
                ahead.extend([r] if (r := next(rows, None)) else [])

        ahead.extend([r] if (r := next(rows, None)) else [])
        while ahead:
            key = ahead[0][:2]
            yield from answers(run(key))
            for _ in run(key):  # what a task without queries or without blocks left unread
                pass

    met = packs.unionByName(data).repartition(min(parts * groups, 4096), "part", "group").sortWithinPartitions("part", "group", "kind")
    maybe = scratch.save(met.mapInArrow(scan, "q bigint, block bigint, pos int, lower double, upper double"))
    # over all blocks: the k-th least upper bound of a query, and its candidates in the order of their lower bounds
    kth = maybe.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("upper"))).filter(F.col("r") <= k)
    kth = kth.groupBy("q").agg(F.max("upper").alias("most"), F.count("*").alias("n")).withColumn("most", F.when(F.col("n") == k, F.col("most") + TIE).otherwise(float("inf"))).drop("n")
    ordered = maybe.join(kth, "q").filter("lower <= most").drop("upper", "most")
    ordered = scratch.save(ordered.withColumn("turn", F.row_number().over(Window.partitionBy("q").orderBy("lower", "block", "pos"))))

    def exactly(wanted: DataFrame) -> DataFrame:
        """(q, vec_id, scaled distance d) of candidates (q, block, pos): the vectors of each block meet the queries that ask for them."""
        asks = wanted.join(asked.select("q", "v"), "q").select("block", F.lit(1).alias("kind"), "q", "pos", "v", F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("vectors"), F.pmod(F.xxhash64("q"), F.lit(spread)).alias("salt"))
        own = blocks.join(wanted.select("block").distinct(), "block", "left_semi").select("block", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("q"), F.lit(None).cast("int").alias("pos"), F.lit(None).cast(good.schema["v"].dataType).alias("v"), "ids", "vectors", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(spread - 1).cast("bigint"))).alias("salt"))

        def read(batches):
            ids = x = None
            for b in batches:
                turns = b.column(1).to_numpy()
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(turns) != 0) + 1, [len(turns)]]) if len(turns) else []
                for a, z in zip(cuts[:-1], cuts[1:]):
                    if turns[a] == 0:  # of several blocks in a row none but the last is asked for
                        ids = np.frombuffer(b.column(5)[int(z) - 1].as_buffer(), np.int64)
                        x = codes.scaled(np.frombuffer(b.column(6)[int(z) - 1].as_buffer(), kind).reshape(-1, dim))
                        continue
                    part = b.slice(a, z - a)
                    pos, q = part.column(3).to_numpy(), codes.scaled(_array(part, 4, dim))
                    d = np.sqrt(((q - x[pos]) ** 2).sum(axis=1))
                    yield pa.RecordBatch.from_arrays([part.column(2), pa.array(ids[pos]), pa.array(d)], ["q", "vec_id", "d"])

        both = own.unionByName(asks).select("block", "kind", "q", "pos", "v", "ids", "vectors", "salt")
        return both.repartition("block", "salt").sortWithinPartitions("block", "salt", "kind").mapInArrow(read, "q bigint, vec_id bigint, d double")

    spread = max(1, -(-n_asked // (64 * QUERIES)))
    first = scratch.save(exactly(ordered.filter(F.col("turn") <= 2 * k)))
    near = first.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d"))).filter(F.col("r") == k).select("q", F.col("d").alias("most"))
    # what the first ones leave open
    rest = ordered.filter(F.col("turn") > 2 * k).join(near, "q").filter(F.col("lower") <= F.col("most") * (1 + 1e-12) + TIE).select("q", "block", "pos")
    rest = scratch.save(rest)
    more = rest.count()
    if counts is not None:
        counts |= {"vectors": n, "queries": n_asked, "candidates": maybe.count(), "exact": first.count() + more}
    all_ = first if not more else first.unionByName(exactly(rest))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.round("d", 9), "vec_id"))
    best = all_.withColumn("rank", place).filter(F.col("rank") <= k).join(asked.select("q", F.col("vec_id").alias("query_id"), "copies"), "q")
    best = best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.round(F.col("d") * float(np.ldexp(1.0, codes.power)), 6).alias("distance"))


ORACLE = """
WITH p AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         sqrt(list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d
  FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(d, 6) AS distance FROM r WHERE rank <= 10
"""

"""MinHash near-duplicates by a multi-index Hamming join.

A document's signature is SYMBOLS MinHash values of its word pairs, each cut to eight bits.
Two signatures within MAX_DISTANCE differing symbols have, by the pigeonhole principle, a
chunk of the signature with at most MAX_DISTANCE // CHUNKS errors; every choice of that many
positions to ignore in a chunk makes a key, so each such pair meets under some key, and is
then verified on whole signatures. Equal signatures are joined first and searched once.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..operators.mutations import number_rows
from .common import WORD_REGEX, Scratch, fresh, grams, lowered, map_arrow, prefix, quoted, span_hash, texts, windows, with_fields, words

SYMBOLS, CHUNKS, MAX_DISTANCE, SHINGLE = 72, 12, 23, 2
#: Members of a list of ids in a result, and signatures of one key that a task compares at a time.
LIST_ROWS, HOT_ROWS = 10_000, 4096
_rng = np.random.default_rng(20_111)
_MUL = _rng.integers(0, 1 << 32, 512, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, 512, dtype=np.uint32)
_TABLE = _rng.integers(0, 1 << 63, (512, 256), dtype=np.uint64)
_IGNORED = _rng.integers(0, 1 << 63, 512, dtype=np.uint64)


def minhash(data: np.ndarray, offs: np.ndarray, symbols: int = SYMBOLS, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(rows with a word, their signatures as uint8) of a run of lower-case texts."""
    s, e, row_offs = words(data, offs)
    h = span_hash(prefix(data), s, e)
    counts = np.diff(row_offs)
    at, row = windows(row_offs, shingle)
    short = np.flatnonzero((counts > 0) & (counts < shingle))
    # a text of fewer words than a shingle has each of its words as a shingle
    few = np.concatenate([np.arange(row_offs[r], row_offs[r + 1]) for r in short]) if len(short) else np.zeros(0, np.int64)
    x = np.concatenate([grams(h, shingle)[at] if len(at) else np.zeros(0, np.uint64), h[few]])
    owner = np.concatenate([row, np.repeat(short, counts[short])])
    if len(few):
        order = np.argsort(owner, kind="stable")
        x, owner = x[order], owner[order]
    if not len(x):
        return np.zeros(0, np.int64), np.zeros((0, symbols), np.uint8)
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    x = (x >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(first), symbols), np.uint8)
    buf = np.empty_like(x)
    for k in range(symbols):
        np.multiply(x, _MUL[k], out=buf)
        np.add(buf, _ADD[k], out=buf)
        least = np.minimum.reduceat(buf, first)
        out[:, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(24)
    return owner[first], out


def _signed(rows: DataFrame, symbols: int) -> DataFrame:
    """The key columns of (keys ..., text) with the text's signature; texts without a word are left out."""
    keys = rows.drop("text")
    names = keys.columns

    def run(batch):
        for lo, _, data, offs in texts(lowered(batch.column("text"))):
            row, sig = minhash(data, offs, symbols)
            if len(row):
                own = [batch.column(k).take(pa.array(row + lo)) for k in names]
                yield pa.RecordBatch.from_arrays([*own, pa.array([x.tobytes() for x in sig], pa.binary())], [*names, "sig"])

    return map_arrow(rows, run, with_fields(keys.schema, sig=T.BinaryType()))


def signatures(docs: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(doc_id, sig) of the documents with an id and at least one word."""
    return _signed(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id IS NOT NULL AND text IS NOT NULL"), symbols)


def chunk_keys(sig: np.ndarray, chunks: int, max_distance: int) -> np.ndarray:
    """All keys of each signature, (rows, keys): a chunk without every choice of max_distance // chunks of its positions."""
    n, symbols = sig.shape
    bounds, errors, out = np.linspace(0, symbols, chunks + 1).astype(int), max_distance // chunks, []
    for a, b in zip(bounds[:-1], bounds[1:]):
        own = _TABLE[np.arange(a, b)[None, :], sig[:, a:b]]
        total = own.sum(axis=1, dtype=np.uint64)
        for gone in combinations(range(b - a), min(errors, b - a)):
            key = total.copy()
            for j in gone:
                key += _IGNORED[a + j] - own[:, j]
            out.append(key)
    return np.stack(out, axis=1) if n else np.zeros((0, len(out)), np.uint64)


def linked(ids: np.ndarray, sig: np.ndarray, max_distance: int, every: bool) -> list[tuple[int, int]]:
    """Pairs within max_distance: all of them, or a forest that joins exactly what they join."""
    out, left = [], np.arange(len(ids))
    if every:
        for k in range(len(ids) - 1):
            near = np.flatnonzero((sig[k + 1 :] != sig[k]).sum(axis=1) <= max_distance) + k + 1
            out += [(ids[k], ids[j]) for j in near]
        return out
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            k = frontier.pop()
            near = (sig[left] != sig[k]).sum(axis=1) <= max_distance
            found, left = left[near], left[~near]
            out += [(ids[k], ids[j]) for j in found]
            frontier += found.tolist()
    return out


def _members(batches, hot: int):
    """Sorted (key, id) rows as (key, part, big, members): the ids of each key that has several, in parts of at most hot ids."""
    key, ids, part = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def batch_of(rows):
        if rows:
            k, p, big, got = zip(*rows)
            offs = np.cumsum([0, *map(len, got)])
            members = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(np.concatenate(got)))
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(p, pa.int32()), pa.array(big), members], ["key", "part", "big", "members"])

    def whole(k, own, done):
        """Rows of a key that has ended, done parts of which were given before."""
        if not done and len(own) <= hot:
            own = np.unique(own)
            return [(k, 0, False, own)] if len(own) > 1 else []
        return [(k, done + n, True, own[lo : lo + hot]) for n, lo in enumerate(range(0, len(own), hot))]

    for b in batches:
        key, ids = np.concatenate([key, b.column(0).to_numpy()]), np.concatenate([ids, b.column(1).to_numpy()])
        if not len(key):
            continue
        start = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
        size, rows = np.diff(start), []  # without the last key, which may go on in the next batch
        for g in np.flatnonzero((size > 1) | (np.arange(len(size)) == 0) & (part > 0)).tolist():
            rows += whole(int(key[start[g]]), ids[start[g] : start[g] + size[g]], part if g == 0 else 0)
        if len(size):
            part = 0
        key, ids = key[start[-1] :], ids[start[-1] :]
        while len(ids) > 2 * hot:
            rows.append((int(key[0]), part, True, ids[:hot]))
            key, ids, part = key[hot:], ids[hot:], part + 1
        yield from batch_of(rows)
    if len(key):
        yield from batch_of(whole(int(key[0]), ids, part))


def hamming_join(sigs: DataFrame, scratch: Scratch, chunks: int = CHUNKS, max_distance: int = MAX_DISTANCE, every: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(a, b), a < b: of rows (id, sig) with different signatures, all pairs within max_distance, or with every=False a forest of them.

    A key of more than hot_rows signatures is never in one task as a whole: its members are cut
    into parts, compared with one of them first, and only those that are far from it are compared
    with all parts, a pair of parts at a time.
    """

    def keys(batch):
        width = len(batch.column(1)[0].as_py())
        for lo in range(0, batch.num_rows, 2048):
            part = batch.slice(lo, 2048)
            sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(-1, width)
            k = chunk_keys(sig, chunks, max_distance)
            ids = np.repeat(part.column(0).to_numpy(), k.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(k.ravel().view(np.int64)), pa.array(ids)], ["key", "id"])

    def verify(batch):
        a, b = [], []
        for group in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))):
            own = {x["id"]: x["sig"] for part in group for x in part}
            ids = np.fromiter(own, np.int64, len(own))
            sig = np.frombuffer(b"".join(own.values()), np.uint8).reshape(len(ids), -1)
            for x, y in linked(ids, sig, max_distance, every):
                a.append(min(x, y))
                b.append(max(x, y))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    keyed = map_arrow(sigs.select("id", "sig"), keys, "key bigint, id bigint")
    parts = int(sigs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = keyed.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(lambda batches: _members(batches, hot_rows), "key bigint, part int, big boolean, members array<bigint>")
    # many keys have the same members: these are compared once
    found = scratch.save(found.withColumn("key", F.when(F.col("big"), F.col("key"))).distinct())
    rows = found.filter("NOT big").select(F.xxhash64("members").alias("bucket"), F.explode("members").alias("id")).join(sigs.select("id", "sig"), "id")
    whole = rows.groupBy("bucket").agg(F.collect_set(F.struct("id", "sig")).alias("group")).select("group")
    out = map_arrow(whole, verify, "a bigint, b bigint")
    if found.filter("big").head(1):
        out = out.unionByName(_hot(found.filter("big"), sigs, scratch, max_distance, every, verify))
    return out.distinct()


def _hot(found: DataFrame, sigs: DataFrame, scratch: Scratch, max_distance: int, every: bool, verify) -> DataFrame:
    """(a, b) of the keys with many members, which are given in parts."""
    rows = scratch.save(found.select("key", "part", F.explode("members").alias("id")).join(sigs.select("id", "sig"), "id"))
    parts = rows.select("key", "part").distinct()
    far, links = rows, None
    if not every:
        pivots = rows.groupBy("key").agg(F.min(F.struct("id", "sig")).alias("pivot"))

        def near(batch):
            ids, other = batch.column(2).to_numpy(), batch.column(4).field(0).to_numpy()
            one, two = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(len(ids), -1) for c in (batch.column(3), batch.column(4).field(1)))
            hit = (one != two).sum(axis=1) <= max_distance
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(other), pa.array(hit)], ["key", "part", "id", "sig", "pivot", "near"])

        # a pivot goes to each part, so that no task gets a whole key
        asked = rows.join(parts.join(pivots, "key"), ["key", "part"]).select("key", "part", "id", "sig", "pivot")
        told = scratch.save(map_arrow(asked, near, "key bigint, part int, id bigint, sig binary, pivot bigint, near boolean"))
        links = told.filter("near AND id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"))
        far = told.filter("NOT near").select("key", "part", "id", "sig")

    def blocks(df, name):
        return df.groupBy("key", "part").agg(F.collect_list(F.struct("id", "sig")).alias(name))

    meet = blocks(far, "one").join(parts.withColumnRenamed("part", "other"), "key").select("key", F.col("other").alias("part"), "one")
    pairs = map_arrow(meet.join(blocks(rows, "two"), ["key", "part"]).select("one", "two"), verify, "a bigint, b bigint")
    return pairs if links is None else links.unionByName(pairs)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root), id > root: the smallest id of each connected component, by alternating large and small stars."""
    now = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).filter("u <> v").distinct()
        after = scratch.save(small)
        scratch.drop(now)
        now, was = after, mark
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == was:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root"))


def _joined(sigs: DataFrame, scratch: Scratch, chunks: int, max_distance: int) -> DataFrame:
    """(id, root) of rows (id, sig)."""
    each = scratch.save(sigs.groupBy("sig").agg(F.min("id").alias("first")))
    same = sigs.join(each, "sig").filter("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    near = hamming_join(each.select(F.col("first").alias("id"), "sig"), scratch, chunks, max_distance)
    return components(same.unionByName(near), scratch)


def near_groups(docs: DataFrame, symbols: int = SYMBOLS, chunks: int = CHUNKS, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(id, root): every document that is joined, by a chain of pairs within max_distance, to the document root of smaller id.

    Documents whose doc_id or text is null, or that have no word, are near to nothing. Rows that
    share a doc_id are one document, near to whatever any of them is near to. No size of group is
    special: equal signatures are joined to their smallest id in one aggregation. An empty table
    gives no rows; other columns, of whatever name, are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "near")
    sigs = scratch.save(signatures(docs, symbols)).withColumnRenamed("doc_id", "id")
    return _joined(sigs, scratch, chunks, max_distance)


def group_lists(groups: DataFrame, list_rows: int = LIST_ROWS) -> DataFrame:
    """(group_id, part, doc_ids): the members of each group in lists of about list_rows; the smallest id is in every list of its group."""
    sizes = groups.groupBy("root").agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / list_rows)).cast("int")
    rows = groups.join(sizes, "root").select("root", part.alias("part"), "id")
    lists = rows.groupBy("root", "part").agg(F.collect_set("id").alias("ids"))
    return lists.select(F.col("root").alias("group_id"), "part", F.array_sort(F.array_append("ids", F.col("root"))).alias("doc_ids"))


def keep_one(docs: DataFrame, symbols: int = SYMBOLS, chunks: int = CHUNKS, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """docs with one row of each near-duplicate group, that of smallest doc_id.

    Rows whose doc_id is null or repeats are documents by id and text: they come after those with
    an id of their own, in the order of id, null last, and text; of equal rows one stays. Texts
    that are null, empty or have no word are near to nothing and stay, all of them. Columns stay
    as they are, of whatever name or type; an empty table gives no rows.
    """
    scratch, names = Scratch(docs.sparkSession, "keep"), docs.columns
    sigs = scratch.save(signatures(docs, symbols))
    odd = scratch.save(sigs.groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    f_id, f_text, f_place = fresh(names, "id", "digest", "place")
    own_id = F.col("doc_id").cast("bigint")
    if not odd.head(1) and not docs.filter("doc_id IS NULL AND text IS NOT NULL").head(1):
        gone = _joined(sigs.withColumnRenamed("doc_id", "id"), scratch, chunks, max_distance).select(F.col("id").alias(f_id))
        return docs.join(gone, own_id == F.col(f_id), "left_anti").select(*quoted(names))

    marked = docs.join(odd.select(F.col("doc_id").alias(f_id)), own_id == F.col(f_id), "left")
    strange = (F.col("doc_id").isNull() | F.col(f_id).isNotNull()) & F.coalesce(F.col("text").rlike(WORD_REGEX), F.lit(False))
    keyed = marked.filter(strange).withColumn(f_text, F.sha2("text", 256))
    texts_ = keyed.select(own_id.alias("doc_id"), F.col(f_text).alias("digest"), "text")
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "digest")
    start = sigs.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
    numbered = scratch.save(number_rows(_signed(texts_, symbols).distinct().withColumn("place", order), "place", "id", start).select("id", "doc_id", "digest", "sig"))
    every = sigs.join(odd, "doc_id", "left_anti").select(F.col("doc_id").alias("id"), "sig").unionByName(numbered.select("id", "sig"))
    gone = scratch.save(_joined(every, scratch, chunks, max_distance).select("id"))
    plain = marked.filter(~strange).join(gone.select(F.col("id").alias(f_place)), own_id.eqNullSafe(F.col(f_place)) & F.col(f_id).isNull(), "left_anti")
    lost = numbered.join(gone, "id", "left_semi").select(F.col("doc_id").alias(f_id), F.col("digest").alias(f_text + "_"))
    # of equal rows the first; the limit on the rank is taken before the shuffle
    first = Window.partitionBy(own_id, f_text).orderBy(F.lit(0))
    once = keyed.drop(f_id).withColumn(f_place, F.row_number().over(first)).filter(F.col(f_place) == 1)
    once = once.join(lost, own_id.eqNullSafe(F.col(f_id)) & (F.col(f_text) == F.col(f_text + "_")), "left_anti")
    return plain.select(*quoted(names)).unionByName(once.select(*quoted(names)))

"""Line deduplication by two Bloom filters.

One pass hashes every line and sends the hashes, packed by hash slice, to the slice's
"once" filter; a hash that the filter has already seen goes to its "twice" filter. Only
lines that the twice filter suspects are shuffled as text, for exact confirmation and for
the choice of the first occurrence; whole texts are shuffled only where what is to be known about
them is too large to broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, fresh, map_arrow, mix, prefix, quoted, span_hash, texts, with_fields

MIN_CHARS = 15
BITS_PER_KEY, PROBES = 12, 4
#: Bytes of filters, and rows (16 bytes each) of places of first occurrences, that may be broadcast.
MAX_BROADCAST_BYTES, MAX_FIRSTS = 64 << 20, 2_000_000
BLANKS = " \t\r"


class Bloom:
    """Scalable Bloom filter over packed bits: when one part is full, another of twice the size is added."""

    def __init__(self, bits: int = 1 << 14):
        self.parts, self.room = [np.zeros(bits >> 3, np.uint8)], bits // BITS_PER_KEY

    @staticmethod
    def _at(h: np.ndarray, bits: int) -> list[np.ndarray]:
        a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
        return [((a + np.uint64(k) * b) & np.uint64(bits - 1)).astype(np.int64) for k in range(PROBES)]

    @staticmethod
    def test(part: np.ndarray, h: np.ndarray) -> np.ndarray:
        hit = np.ones(len(h), bool)
        for at in Bloom._at(h, 8 * len(part)):
            hit &= (part[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return hit

    def seen(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), bool)
        for p in self.parts:
            out |= self.test(p, h)
        return out

    def add(self, h: np.ndarray) -> None:
        while len(h):
            if self.room <= 0:
                self.parts.append(np.zeros(2 * len(self.parts[-1]), np.uint8))
                self.room = 8 * len(self.parts[-1]) // BITS_PER_KEY
            now, h = h[: self.room], h[self.room :]
            self.room -= len(now)
            for at in self._at(now, 8 * len(self.parts[-1])):
                low = at & 7
                for bit in range(8):
                    self.parts[-1][at[low == bit] >> 3] |= np.uint8(1 << bit)


def packed_filter(h: np.ndarray) -> bytes:
    """A Bloom filter of the right size for h, as packed bits."""
    bits = 1 << max(6, int(len(h) * BITS_PER_KEY - 1).bit_length())
    f = Bloom(bits)
    f.room = len(h)
    f.add(h)
    return f.parts[0].tobytes()


def in_packed(filters: dict[int, np.ndarray], slices: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash is, or seems to be, in its slice's packed filter."""
    out = np.zeros(len(h), bool)
    order = np.argsort(slices, kind="stable")
    cut = np.flatnonzero(np.diff(slices[order])) + 1
    for part in np.split(order, cut):
        f = filters.get(int(slices[part[0]])) if len(part) else None
        if f is None:
            continue
        out[part] = Bloom.test(f, h[part])
    return out


_BLANK = np.zeros(256, bool)
_BLANK[[ord(c) for c in BLANKS]] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True


def lines(data: np.ndarray, offs: np.ndarray, min_chars: int):
    """(row, line number, start, end, hash) of the lines, without surrounding blanks, of at least min_chars characters."""
    breaks = np.flatnonzero(data == 10)
    # a line belongs to the text in which its break lies; empty texts have one empty line each
    owner = np.concatenate([np.arange(len(offs) - 1), np.searchsorted(offs, breaks, side="right") - 1])
    start = np.concatenate([offs[:-1], breaks + 1])
    order = np.lexsort((start, owner))
    row, starts = owner[order], start[order]
    last = np.append(row[1:] != row[:-1], True)
    ends = np.where(last, offs[row + 1], np.append(starts[1:], 0) - 1)
    first_of_row = np.searchsorted(row, np.arange(len(offs) - 1))
    number = np.arange(len(row)) - first_of_row[row]
    solid = np.flatnonzero(~_BLANK[data] & ~_NEWLINE[data])
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    full = np.flatnonzero(b > a)
    s, e = solid[a[full]], solid[b[full] - 1] + 1
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    long = chars[e] - chars[s] >= min_chars
    full, s, e = full[long], s[long], e[long]
    return row[full], number[full], s, e, span_hash(prefix(data), s, e)


def _slice(h: np.ndarray, n_slices: int) -> np.ndarray:
    return (mix(h) >> np.uint64(64 - (n_slices.bit_length() - 1))).astype(np.int64) if n_slices > 1 else np.zeros(len(h), np.int64)


def _groups(slices: np.ndarray):
    order = np.argsort(slices, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(slices[order])) + 1):
        if len(part):
            yield int(slices[part[0]]), part


def twice_filters(docs: DataFrame, n_slices: int, min_chars: int) -> DataFrame:
    """(slice, filter): by hash slice, the filter of line hashes that occur at least twice."""

    def hashes(batch):
        got = [lines(data, offs, min_chars)[4] for _, _, data, offs in texts(batch.column("text"))]
        h, n = np.unique(np.concatenate(got), return_counts=True)
        rows = [(k, h[part].tobytes(), h[part][n[part] > 1].tobytes()) for k, part in _groups(_slice(h, n_slices))]
        if rows:
            k, once, twice = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())], ["slice", "once", "twice"])

    def filters(batches):
        now, once, twice = None, None, []  # one slice at a time

        def result():
            h = np.unique(np.concatenate(twice)) if twice else np.zeros(0, np.uint64)
            if len(h):
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([packed_filter(h)], pa.binary())], ["slice", "filter"])

        for b in batches:
            for k, o, t in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                if k != now:
                    yield from result()
                    now, once, twice = k, Bloom(), []
                h = np.frombuffer(o.as_buffer(), np.uint64)
                old = once.seen(h)
                once.add(h[~old])
                twice += [h[old], np.frombuffer(t.as_buffer(), np.uint64)]
                if len(twice) > 64:
                    twice = [np.unique(np.concatenate(twice))]
        yield from result()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = map_arrow(docs.select("text"), hashes, "slice int, once binary, twice binary")
    return hashed.repartition(parts, "slice").sortWithinPartitions("slice").mapInArrow(filters, "slice int, filter binary")


def _suspects_by_shuffle(docs: DataFrame, filters: DataFrame, n_slices: int, min_chars: int) -> DataFrame:
    """(doc_id, digest of the text, line numbers) by sending packed line hashes to their slice's filter; for filters too large to broadcast."""
    schema = "slice int, kind int, filter binary, ids array<bigint>, bodies array<string>, numbers array<int>, hashes binary"

    def hashes(batch):
        ids, bodies = batch.column("doc_id"), batch.column("body")
        for lo, _, data, offs in texts(batch.column("text")):
            row, number, _, _, h = lines(data, offs, min_chars)
            own, body = ids.take(pa.array(row + lo)), bodies.take(pa.array(row + lo))
            out = [(k, 1, None, own.take(pa.array(p)).to_pylist(), body.take(pa.array(p)).to_pylist(), number[p].tolist(), h[p].tobytes()) for k, p in _groups(_slice(h, n_slices))]
            if out:
                types = [pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["slice", "kind", "filter", "ids", "bodies", "numbers", "hashes"])

    def test(batches):
        now: dict[int, np.ndarray] = {}
        for b in batches:
            for r in b.to_pylist():
                if r["kind"] == 0:
                    now = {r["slice"]: np.frombuffer(r["filter"], np.uint8)}
                    continue
                h = np.frombuffer(r["hashes"], np.uint64)
                at = np.flatnonzero(in_packed(now, np.full(len(h), r["slice"]), h))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([r["ids"][i] for i in at], pa.int64()), pa.array([r["bodies"][i] for i in at], pa.string()), pa.array([r["numbers"][i] for i in at], pa.int32())], ["doc_id", "body", "number"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = map_arrow(docs.select("doc_id", "text", "body"), hashes, schema)
    own = filters.select("slice", F.lit(0).alias("kind"), "filter", F.lit(None).cast("array<bigint>").alias("ids"), F.lit(None).cast("array<string>").alias("bodies"), F.lit(None).cast("array<int>").alias("numbers"), F.lit(None).cast("binary").alias("hashes"))
    found = own.unionByName(sent).repartition(parts, "slice").sortWithinPartitions("slice", "kind").mapInArrow(test, "doc_id bigint, body string, number int")
    return found.groupBy("doc_id", "body").agg(F.collect_set("number").alias("suspects"))


class Firsts:
    """Where suspected lines occur first: rows by id, null ids apart."""

    def __init__(self, rows: pa.Table):
        ids, numbers = rows["d"], rows["l"].to_numpy().astype(np.int32)
        null = ids.is_null().to_numpy()
        self.null = set(numbers[null].tolist())
        ids, numbers = pc.fill_null(ids, 0).to_numpy()[~null], numbers[~null]
        order = np.argsort(ids, kind="stable")
        self.ids, self.numbers = ids[order], numbers[order]

    def of(self, doc_id: int | None) -> set[int]:
        if doc_id is None:
            return self.null
        a, b = np.searchsorted(self.ids, doc_id), np.searchsorted(self.ids, doc_id, side="right")
        return set(self.numbers[a:b].tolist())


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, max_broadcast: int = MAX_BROADCAST_BYTES, max_firsts: int = MAX_FIRSTS) -> DataFrame:
    """docs with every later occurrence of a repeated line removed; adds n_removed (int).

    A line is what lies between line feeds, compared without surrounding blanks, tabs and
    carriage returns. Lines of fewer than min_chars characters always stay. Occurrences are
    ordered by (doc_id, line number), null ids last; of equal doc_ids each row keeps the lines
    of which that id has the first occurrence at that line number, so repeated rows stay alike.
    A null text stays null and has n_removed 0, an empty one stays empty; an empty table gives no
    rows. All other columns pass through unchanged, of whatever name or type, apart from an
    existing n_removed, which is replaced.

    Only suspected lines are shuffled. The filters and the places of first occurrences are
    broadcast up to max_broadcast bytes and max_firsts rows; beyond the first, hashes are sent to
    their slice of the filters, and beyond either, texts with a suspect meet their places by
    shuffle. Both ways give the same rows.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_removed")
    n_slices = 1 << max(4, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    scratch = Scratch(spark, "lines")
    filters = scratch.save(twice_filters(docs, n_slices, min_chars))
    total = filters.agg(F.coalesce(F.sum(F.length("filter")), F.lit(0))).first()[0]
    names, schema = docs.columns, docs.schema
    key, body, id_at = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), names.index("text"), names.index("doc_id")
    f_suspects, f_first, f_id, f_body, f_doc = fresh(names, "suspects", "first", "id", "body", "doc")
    wide = with_fields(schema, **{f_suspects: T.ArrayType(T.IntegerType())})
    shared = None

    if total <= max_broadcast:
        shared = spark.sparkContext.broadcast({r["slice"]: r["filter"] for r in filters.collect()})

        def suspects_of(column):
            own = {k: np.frombuffer(v, np.uint8) for k, v in shared.value.items()}
            for lo, hi, data, offs in texts(column):
                row, number, s, e, h = lines(data, offs, min_chars)
                hit = np.flatnonzero(in_packed(own, _slice(h, n_slices), h))
                yield lo, hi, data, row[hit], number[hit], s[hit], e[hit]

        def by_row(batch) -> list[list[int]]:
            out = [[] for _ in range(batch.num_rows)]
            for lo, _, _, row, number, _, _ in suspects_of(batch.column(body)):
                for r, n in zip((row + lo).tolist(), number.tolist()):
                    out[r].append(n)
            return out

        def found(batch):
            ids = batch.column(0)
            for lo, _, data, row, number, s, e in suspects_of(batch.column(1)):
                if len(row):
                    raw = data.tobytes()
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row + lo)), pa.array(number, pa.int32()), pa.array([raw[a:b].decode() for a, b in zip(s.tolist(), e.tolist())], pa.string())], ["doc_id", "number", "line"])

        suspects = map_arrow(key, found, "doc_id bigint, number int, line string")
    else:
        # rows are found again by id and a digest of the text, since ids may repeat or be null
        own_key = key.withColumn("body", F.sha2("text", 256))
        numbers = scratch.save(_suspects_by_shuffle(own_key, filters, n_slices, min_chars).withColumnsRenamed({"doc_id": "id", "body": "digest"}))
        held = own_key.join(numbers, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("body") == F.col("digest")))
        each = held.select("doc_id", "text", F.explode("suspects").alias("number"))
        suspects = each.select("doc_id", "number", F.expr(r"trim(BOTH ' \t\r' FROM element_at(split(text, '\n', -1), number + 1))").alias("line"))

    # of each line the first place: what is exact about it is the text itself
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("number").alias("l"))
    firsts = scratch.save(suspects.groupBy("line").agg(F.min(order).alias("at")).select("at.d", "at.l"))

    def edited(cols: list, rows: list[tuple[list[int], set[int]]]) -> pa.RecordBatch:
        out, n = cols[body].to_pylist(), []
        for k, (suspect, first) in enumerate(rows):
            gone = set(suspect) - first if suspect else set()
            n.append(len(gone))
            if gone:
                out[k] = "\n".join(x for i, x in enumerate(out[k].split("\n")) if i not in gone)
        cols = [*cols]
        cols[body] = pa.array(out, cols[body].type)
        return pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int32())], [*names, "n_removed"])

    final = with_fields(schema, n_removed=T.IntegerType())
    if shared is not None and firsts.count() <= max_firsts:
        places = spark.sparkContext.broadcast(Firsts(firsts.toArrow()))

        def edit_here(batch):
            ids = batch.column(id_at).cast(pa.int64()).to_pylist()
            yield edited(batch.columns, [(s, places.value.of(i) if s else set()) for s, i in zip(by_row(batch), ids)])

        return map_arrow(docs, edit_here, final)

    if shared is not None:

        def marked(batch):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x or None for x in by_row(batch)], pa.list_(pa.int32()))], [*names, f_suspects])

        everything = map_arrow(docs, marked, wide)
    else:
        again = numbers.select(F.col("id").alias(f_id), F.col("digest").alias(f_body), F.col("suspects").alias(f_suspects))
        own = F.col("doc_id").cast("bigint").eqNullSafe(F.col(f_id)) & (F.sha2("text", 256) == F.col(f_body))
        everything = docs.join(again, own, "left").drop(f_id, f_body)
    kept = firsts.groupBy(F.col("d").alias(f_doc)).agg(F.collect_set("l").alias(f_first))

    def edit(batch):
        first, suspect = batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()
        yield edited(batch.columns[: len(names)], [(s or [], set(f or ())) for s, f in zip(suspect, first)])

    clean = everything.filter(F.col(f_suspects).isNull()).select(*quoted(names), F.lit(0).alias("n_removed"))
    # by shuffle at every size; the side built per partition holds only line numbers
    dirty = everything.filter(F.col(f_suspects).isNotNull()).join(kept.hint("shuffle_hash"), F.col("doc_id").cast("bigint").eqNullSafe(F.col(f_doc)), "left")
    return clean.unionByName(map_arrow(dirty.select(*quoted(names), f_first, f_suspects), edit, final))


ORACLE = """
WITH l AS (
  SELECT doc_id, number, part, trim(part, ' ' || chr(9) || chr(13)) AS line
  FROM (SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS number
        FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))
), r AS (
  SELECT *, length(line) >= 15 AND row_number() OVER (PARTITION BY line ORDER BY doc_id, number) > 1 AS gone FROM l
)
SELECT doc_id, coalesce(string_agg(part, chr(10) ORDER BY number) FILTER (WHERE NOT gone), '') AS text,
       CAST(count(*) FILTER (WHERE gone) AS INTEGER) AS n_removed
FROM r GROUP BY doc_id
"""

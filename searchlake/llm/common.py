"""Shared parts of the training-data operators: scratch tables in the cluster's shared
folder, and whole-batch text hashing in numpy over Arrow string buffers."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import shared_dir

CHUNK_BYTES = 1 << 20
#: Bytes of an Arrow batch, where the session sets no bound: ten thousand rows of long texts would not fit in a worker.
BATCH_BYTES, _BATCH_CONF = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
_ODD = 0x9E3779B97F4A7C15
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)


class Scratch:
    """Tables written to the shared folder, so that no later stage depends on an executor's disk.

    Tables that a returned DataFrame still reads stay until clear() or the end of the driver.
    """

    _all: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/searchlake-{name}-{uuid.uuid4().hex[:12]}", 0
        Scratch._all.append(self)

    def save(self, df: DataFrame) -> DataFrame:
        """Write df once and return a DataFrame that reads the written table."""
        self.n += 1
        path = f"{self.base}/{self.n}"
        schema = df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete the table behind a DataFrame that save() returned."""
        self._delete(df._scratch_path)

    def clear(self) -> None:
        self._delete(self.base)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clear_scratch() -> None:
    for s in Scratch._all:
        if s.spark.sparkContext._jsc is not None:
            try:
                s.clear()
            except Exception:  # the JVM is gone; nothing is left to tell
                return


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow of a function from one batch to several. Where the session sets no bound on a batch's bytes it gets BATCH_BYTES."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_CONF, None) is None:
        conf.set(_BATCH_CONF, str(BATCH_BYTES))

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield from fn(b)

    return df.mapInArrow(run, schema)


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with underscores behind it until no column of a table is called so, in any case."""
    used, out = {c.lower() for c in taken}, []
    for n in names:
        while n.lower() in used:
            n += "_"
        used.add(n.lower())
        out.append(n)
    return out


def with_fields(schema: T.StructType, **fields: T.DataType) -> T.StructType:
    """A schema with more fields behind its own; names of nested fields may hold anything."""
    return T.StructType([*schema.fields, *(T.StructField(k, v) for k, v in fields.items())])


def quoted(names: list[str]) -> list:
    """Columns by their exact names."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the odd multiplier and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << max(16, n - 1).bit_length() if n > 1 << 16 else 1 << 16
        for k, m in enumerate((_ODD, _ODD_INVERSE)):
            a = np.full(size, m, np.uint64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def texts(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about limit bytes: (first row, end row, UTF-8 bytes, offsets). A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    bufs = column.buffers()
    offs = np.frombuffer(bufs[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


_WORD = np.zeros(256, bool)
_WORD[128:] = True
_WORD[[*range(48, 58), *range(97, 123), *range(65, 91)]] = True

#: Beyond ASCII: characters that part words (punctuation, symbols, blanks), and those of scripts without blanks, each a word of its own.
PARTING = [(0x80, 0xA9), (0xAB, 0xB4), (0xB6, 0xB9), (0xBB, 0xBF), (0xD7, 0xD7), (0xF7, 0xF7), (0x2000, 0x2BFF), (0x2E00, 0x2E7F), (0x3000, 0x303F), (0xFE10, 0xFE1F), (0xFE30, 0xFE6F), (0xFF00, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65), (0xFFF0, 0xFFFF), (0x1F000, 0x1FAFF)]
ALONE = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x2FDF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]
_KIND = np.zeros(0x40000, np.uint8)
for _ranges, _number in ((PARTING, 1), (ALONE, 2)):
    for _a, _b in _ranges:
        _KIND[_a : _b + 1] = _number


def _class(ranges) -> str:
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]"


def _between(ranges) -> list[tuple[int, int]]:
    """What ranges leave out, from 0x80 on; surrogates are no characters."""
    out, at = [], 0x80
    for a, b in [*sorted([*ranges, (0xD800, 0xDFFF)]), (0x110000, 0)]:
        if at < a:
            out.append((at, a - 1))
        at = b + 1
    return out


#: A word: a maximal run of ASCII letters or digits and of characters beyond ASCII that are neither PARTING nor ALONE, or one of ALONE. The same in Spark and DuckDB.
WORD_REGEX = _class(ALONE) + "|[0-9A-Za-z" + _class(_between([*PARTING, *ALONE]))[1:] + "+"


def words(data: np.ndarray, offs: np.ndarray, member: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row offsets into them) of the words in a run of texts; no word crosses texts. With another member, of the runs of those bytes."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = member[data]
    edge = np.zeros(len(data) + 1, bool)
    if member is _WORD and len(lead := np.flatnonzero(data >= 0xC2)):
        first = data[lead].astype(np.int32)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        code = np.where(size == 2, first & 31, np.where(size == 3, first & 15, first & 7))
        for j in (1, 2, 3):
            code = np.where(size > j, (code << 6) | (data[np.minimum(lead + j, len(data) - 1)] & 63), code)
        kind = np.where(code < len(_KIND), _KIND[np.minimum(code, len(_KIND) - 1)], 0)
        for j in range(4):
            inside[lead[(kind == 1) & (size > j)] + j] = False
        own = kind == 2
        edge[lead[own]] = edge[lead[own] + size[own]] = True
    edge[0] = edge[-1] = True
    edge[1:-1] |= inside[1:] != inside[:-1]
    edge[offs] = True
    at = np.flatnonzero(edge)
    keep = inside[at[:-1]]
    starts, ends = at[:-1][keep], at[1:][keep]
    return starts, ends, np.searchsorted(starts, offs)


def prefix(data: np.ndarray) -> np.ndarray:
    """Running sums by which span_hash() hashes any span in constant time."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans; equal bytes have equal hashes wherever they are."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts] + (ends - starts).astype(np.uint64))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n consecutive values; len(h) - n + 1 of them."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        out *= np.uint64(_ODD)
        out += h[k : k + len(out)]
    return mix(out)


def windows(row_offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows of n words in texts: (indices of valid starts, row of each)."""
    counts = np.maximum(0, np.diff(row_offs) - n + 1)
    rows = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return np.arange(len(rows)) - first[rows] + row_offs[rows] if len(rows) else np.zeros(0, np.int64), rows


def lowered(column: pa.Array) -> pa.Array:
    """Texts in lower case, in C; a null stays null."""
    return pc.utf8_lower(column)


def binary(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([p.tobytes() for p in parts], pa.binary())


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")

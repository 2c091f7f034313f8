"""Benchmark decontamination by n-grams of words.

The benchmark's n-grams are normalised (lower case, words only) and hashed into a broadcast
set; training texts are scanned window by window, a hash hit is verified on the words
themselves, and verified hits become spans. Benchmarks with more n-grams than the broadcast
bound are joined by shuffle instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_REGEX, Scratch, fresh, grams, lowered, map_arrow, prefix, quoted, span_hash, texts, windows, words
from .linededup import Bloom

N, MIN_WORDS, DROP_SHARE = 8, 5, 0.5
#: The benchmark is broadcast while it has no more words and no more bytes than this.
MAX_BROADCAST_GRAMS, MAX_BROADCAST_BYTES = 500_000, 32 << 20
#: Beyond it a filter of its n-grams' hashes is broadcast: so many parts of at most so many bytes.
FILTER_PARTS, FILTER_PART_BYTES = 64, 1 << 20


class GramSet:
    """Benchmark n-grams: by size their sorted hashes, and for each the item and the place of its words in one run of bytes."""

    def __init__(self, items: list[tuple[int, str]], n: int, min_words: int):
        raws, at, found = [], 0, {}
        for item, text in items:
            for _, _, data, offs in texts(lowered(pa.array([text], pa.string()))):
                s, e, _ = words(data, offs)
                size = min(n, len(s))
                if size < min_words:
                    continue
                h, raw = grams(span_hash(prefix(data), s, e), size), data.tobytes()
                raws.append(b" ".join(raw[a:b] for a, b in zip(s.tolist(), e.tolist())))
                start = at + np.concatenate([[0], np.cumsum(e - s + 1)])
                found.setdefault(size, []).append((h, np.full(len(h), item), start[: len(h)], start[size : size + len(h)] - 1))
                at += len(raws[-1])
        self.raw, self.sizes, self._index = b"".join(raws), {}, None
        for size, parts in found.items():
            h, item, a, b = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((item, h))
            self.sizes[size] = tuple(x[order] for x in (h, item, a, b))

    def index(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By gram size: a bitmap over the hashes' low bits, and the sorted hashes; made once in each Python worker."""
        if self._index is None:
            self._index = {}
            for size, (h, _, _, _) in self.sizes.items():
                bits = max(16, (16 * len(h)).bit_length())
                low = np.zeros(1 << bits, bool)
                low[(h & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
                self._index[size] = low, h
        return self._index

    def items(self, size: int, k: int, own: bytes) -> set[int]:
        """The items that have the gram of the k-th hash and those after it, where the words are the same."""
        h, item, a, b = self.sizes[size]
        out = set()
        for j in range(k, len(h)):
            if h[j] != h[k]:
                break
            if int(item[j]) not in out and self.raw[a[j] : b[j]] == own:
                out.add(int(item[j]))
        return out


def _joined(raw: bytes, s: np.ndarray, e: np.ndarray, k: int, size: int) -> bytes:
    return b" ".join(raw[a:b] for a, b in zip(s[k : k + size].tolist(), e[k : k + size].tolist()))


def scan(column: pa.Array, known: GramSet, index: dict):
    """(row, item, first word, words) of each verified window of a column of texts."""
    for lo, _, data, offs in texts(lowered(column)):
        s, e, row_offs = words(data, offs)
        if not len(s):
            continue
        h, raw = span_hash(prefix(data), s, e), None
        for size, (low, full) in index.items():
            g = grams(h, size)
            near = np.flatnonzero(low[(g & np.uint64(len(low) - 1)).astype(np.int64)])
            first = np.minimum(np.searchsorted(full, g[near]), len(full) - 1)
            hit = full[first] == g[near]
            near, first = near[hit], first[hit]
            if not len(near):
                continue
            row = np.searchsorted(row_offs, near, side="right") - 1
            inside = near + size <= row_offs[row + 1]
            raw = raw or data.tobytes()
            for k, r, j in zip(near[inside].tolist(), row[inside].tolist(), first[inside].tolist()):
                for item in known.items(size, j, _joined(raw, s, e, k, size)):
                    yield lo + r, item, k - int(row_offs[r]), size


def _grams_of(df: DataFrame, key: str, n: int, min_words: int, sizes: list[int] | None = None, filters=None) -> DataFrame:
    """(key, pos, size, h, gram) of the windows: of a benchmark's items where sizes is None, else of texts, of those sizes and where the filters have their hash."""

    def run(batch):
        ids = batch.column(0)
        own = {k: np.frombuffer(v, np.uint8) for k, v in filters.value.items()} if filters else None
        for lo, _, data, offs in texts(lowered(batch.column(1))):
            s, e, row_offs = words(data, offs)
            raw, counts, hashes = data.tobytes(), np.diff(row_offs), span_hash(prefix(data), s, e)
            for size in sizes or range(min_words, n + 1):
                at, row = windows(row_offs, size)
                if sizes is None and size < n:  # a benchmark item shorter than n has one window: itself
                    at, row = at[counts[row] == size], row[counts[row] == size]
                h = grams(hashes, size)[at] if len(at) else np.zeros(0, np.uint64)
                if own is not None and len(at):
                    part, hit = (h >> np.uint64(58)).astype(np.int64), np.zeros(len(h), bool)
                    for p in np.unique(part).tolist():
                        if p in own:
                            hit[part == p] = Bloom.test(own[p], h[part == p])
                    at, row, h = at[hit], row[hit], h[hit]
                if len(at):
                    cols = [ids.take(pa.array(row + lo)), pa.array(at - row_offs[row], pa.int32()), pa.array(np.full(len(at), size), pa.int32()), pa.array(h.view(np.int64))]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array([_joined(raw, s, e, k, size).decode() for k in at.tolist()])], [key, "pos", "size", "h", "gram"])

    kind = df.schema[key].dataType.simpleString()
    return map_arrow(df.select(key, "text"), run, f"{key} {kind}, pos int, size int, h bigint, gram string")


def _filter_parts(own: DataFrame, scratch: Scratch) -> dict[int, bytes]:
    """A Bloom filter of the grams' hashes in FILTER_PARTS parts by their high bits. Its size is bounded; past that more windows pass it, and are told apart by the join."""

    def build(batches):
        part, h = None, []

        def result():
            keys = np.unique(np.concatenate(h))
            bits = min(8 * FILTER_PART_BYTES, 1 << max(9, (12 * len(keys)).bit_length()))
            f = Bloom(bits)
            f.room = len(keys)
            f.add(keys)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([f.parts[0].tobytes()], pa.binary())], ["part", "filter"])

        for b in batches:
            parts, x = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            for p in np.unique(parts).tolist():
                if p != part:
                    if h:
                        yield result()
                    part, h = p, []
                h = [np.unique(np.concatenate([*h, x[parts == p]]))]
        if h:
            yield result()

    keyed = own.select(F.shiftrightunsigned("h", 58).cast("int").alias("part"), "h").distinct()
    made = scratch.save(keyed.repartition(FILTER_PARTS, "part").sortWithinPartitions("part").mapInArrow(build, "part int, filter binary"))
    return {r["part"]: r["filter"] for r in made.collect()}


def _matched(docs: DataFrame, key: str, bench: DataFrame, n: int, min_words: int) -> DataFrame:
    """(key, item_id, pos, size) of verified windows, for benchmarks too large to broadcast: only windows that pass the filter are shuffled."""
    scratch = Scratch(docs.sparkSession, "leaks")
    own = scratch.save(_grams_of(bench, "item_id", n, min_words).select("item_id", "size", "h", "gram").distinct())
    sizes = sorted(r[0] for r in own.select("size").distinct().collect())
    if not sizes:
        return docs.select(key, F.lit(0).cast("bigint").alias("item_id"), F.lit(0).alias("pos"), F.lit(0).alias("size")).limit(0)
    filters = docs.sparkSession.sparkContext.broadcast(_filter_parts(own, scratch))
    return _grams_of(docs, key, n, min_words, sizes, filters).join(own, ["h", "size", "gram"]).select(key, "item_id", "pos", "size")


def _usable(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL")


def find_leaks(docs: DataFrame, benchmark: DataFrame, n: int = N, min_words: int = MIN_WORDS, max_grams: int = MAX_BROADCAST_GRAMS) -> DataFrame:
    """(doc_id, item_id, n_windows, first_word, last_word): documents that share a run of n words with a benchmark item.

    Words are runs of letters and digits in lower case, and single characters of scripts without
    blanks. An item shorter than n words counts by
    its whole text if it has min_words, else not at all. Rows with a null doc_id, item_id or text
    give nothing, nor do empty texts or tables; rows that share a doc_id are one document, whose
    windows are counted by place; repeated items count once. Texts of any length are read whole;
    other columns, of whatever name, are not looked at.
    """
    bench = _usable(benchmark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
    known = _collected(bench, n, min_words, max_grams)
    if known is not None:
        shared = docs.sparkSession.sparkContext.broadcast(known)

        def run(batch):
            got = list(scan(batch.column(1), shared.value, shared.value.index()))
            if got:
                row, item, pos, size = (np.array(x, np.int64) for x in zip(*got))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(item), pa.array(pos, pa.int32()), pa.array(size, pa.int32())], ["doc_id", "item_id", "pos", "size"])

        hits = map_arrow(docs, run, "doc_id bigint, item_id bigint, pos int, size int")
    else:
        hits = _matched(docs, "doc_id", bench, n, min_words)
    return hits.groupBy("doc_id", "item_id").agg(
        F.countDistinct("pos").cast("int").alias("n_windows"), F.min("pos").alias("first_word"), F.max(F.col("pos") + F.col("size") - 1).alias("last_word")
    )


def _collected(bench: DataFrame, n: int, min_words: int, max_grams: int) -> GramSet | None:
    """The benchmark's n-grams on the driver, or None where it has more words than max_grams or more bytes than MAX_BROADCAST_BYTES."""
    n_words = F.size(F.regexp_extract_all("text", F.lit(WORD_REGEX), F.lit(0)))
    sizes = bench.agg(F.coalesce(F.sum(n_words), F.lit(0)), F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()
    if sizes[0] > max_grams or sizes[1] > MAX_BROADCAST_BYTES:
        return None
    return GramSet([(r[0], r[1]) for r in bench.distinct().collect()], n, min_words)


def cut_spans(text: str, taken: np.ndarray) -> str:
    """The text without the words that taken marks, and without what lies between marked neighbours."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    s, e, _ = words(data, np.array([0, len(data)]))
    keep, at = [], 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], taken.astype(np.int8), [0]])))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        keep.append(raw[at : s[a]])
        at = int(e[b - 1])
    return b"".join([*keep, raw[at:]]).decode()


def clean(docs: DataFrame, benchmark: DataFrame, n: int = N, min_words: int = MIN_WORDS, drop_share: float = DROP_SHARE, max_grams: int = MAX_BROADCAST_GRAMS) -> DataFrame:
    """docs without the benchmark's words: spans are cut; a document of which they are more than drop_share goes.

    Two hits of the same item that are at most n words apart make one span, so that small edits
    inside a copied passage go with it. Columns stay as they are, of whatever name or type; n_chars,
    where there is one, follows the text. Null and empty texts stay as they are; repeated rows are
    cleaned alike; an empty table gives no rows, an empty benchmark all rows.
    """
    bench = _usable(benchmark)
    names, schema = docs.columns, docs.schema
    body, size_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    known = _collected(bench, n, min_words, max_grams)

    def emit(batch, hits: dict[int, list[tuple[int, int, int]]]):
        cols, keep = list(batch.columns[: len(names)]), np.ones(batch.num_rows, bool)
        if hits:
            text = cols[body].to_pylist()
            sizes = cols[size_at].to_pylist() if size_at is not None else None
            for row, found in hits.items():
                raw = np.frombuffer(text[row].encode(), np.uint8)
                taken = np.zeros(len(words(raw, np.array([0, len(raw)]))[0]), bool)
                last: dict[int, int] = {}
                for pos, item, length in sorted((p, i, m) for i, p, m in found):
                    start = last[item] if item in last and pos - last[item] <= n else pos
                    taken[start : pos + length] = True
                    last[item] = pos + length
                keep[row] = taken.mean() <= drop_share
                if keep[row]:
                    text[row] = cut_spans(text[row], taken)
                    if sizes is not None:
                        sizes[row] = len(text[row])
            cols[body] = pa.array(text, cols[body].type)
            if sizes is not None:
                cols[size_at] = pa.array(sizes, cols[size_at].type)
        out = pa.RecordBatch.from_arrays(cols, names)
        yield out if keep.all() else out.filter(pa.array(keep))

    if known is not None:
        shared = docs.sparkSession.sparkContext.broadcast(known)

        def run(batch):
            hits: dict = {}
            for row, item, pos, size in scan(batch.column(body), shared.value, shared.value.index()):
                hits.setdefault(row, []).append((item, pos, size))
            yield from emit(batch, hits)

        return map_arrow(docs, run, schema)

    # by shuffle, documents are found again by a digest of their text, so that nothing hangs on the ids
    f_key, f_hits = fresh(names, "digest", "hits")
    marked = docs.select(F.sha2("text", 256).alias("digest"), "text").filter("text IS NOT NULL")
    found = _matched(marked, "digest", bench, n, min_words).groupBy(F.col("digest").alias(f_key)).agg(F.collect_set(F.struct("item_id", "pos", "size")).alias(f_hits))
    joined = docs.join(found, F.sha2("text", 256) == F.col(f_key), "left").select(*quoted(names), f_hits)

    def apply(batch):
        got = batch.column(len(names)).to_pylist()
        yield from emit(batch, {k: [(h["item_id"], h["pos"], h["size"]) for h in x] for k, x in enumerate(got) if x})

    return map_arrow(joined, apply, schema)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), 'WORD') AS t FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), 'WORD') AS t FROM benchmark),
g AS (SELECT DISTINCT item_id, least(8, len(t)) AS n, array_to_string(list_slice(t, i, i + least(8, len(t)) - 1), ' ') AS gram
      FROM (SELECT item_id, t, unnest(range(1, len(t) - least(8, len(t)) + 2)) AS i FROM b WHERE len(t) >= 5)),
w AS (SELECT doc_id, n, i - 1 AS pos, array_to_string(list_slice(t, i, i + n - 1), ' ') AS gram
      FROM (SELECT doc_id, t, n, unnest(range(1, len(t) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g)))
SELECT doc_id, item_id, CAST(count(DISTINCT pos) AS INTEGER) AS n_windows, CAST(min(pos) AS INTEGER) AS first_word,
       CAST(max(pos + w.n - 1) AS INTEGER) AS last_word
FROM w JOIN g ON w.n = g.n AND w.gram = g.gram GROUP BY doc_id, item_id
""".replace("WORD", WORD_REGEX)

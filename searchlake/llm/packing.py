"""Sum-of-squares packing of documents into training windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, texts, words

WINDOW, SHARD_WINDOWS = 2048, 8192
#: Rows of one doc_id and length beyond which they are spread over several shards.
HOT_ROWS = 10_000


class Packer:
    """Online sum-of-squares packing: counts[h] is the number of open windows filled to level h."""

    def __init__(self, window: int):
        self.window, self.next = window, 0
        self.counts = np.zeros(window + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def place(self, size: int) -> tuple[int, int]:
        """(window, offset) of an item of 0 < size <= window, at the level that leaves the least sum of squared counts; of equal ones the fullest."""
        w, c = self.window, self.counts
        best, least = 0, (2 * int(c[size]) + 1 if size < w else 0)
        if size < w:
            # levels 1 .. w - size; a window that gets full leaves the sum
            own, then = c[1 : w - size + 1], 2 * c[1 + size : w + 1] + 1
            then[-1] = 0
            change = np.where(own > 0, then - 2 * own + 1, 1 << 60)[::-1]
            k = int(change.argmin())
            if change[k] <= least:
                best = len(change) - k
        if best:
            c[best] -= 1
            at = self.open[best].pop()
        else:
            at, self.next = self.next, self.next + 1
        if best + size < w:
            c[best + size] += 1
            self.open[best + size].append(at)
        return at, best

    def whole(self, n: int) -> range:
        """n windows that one document fills by itself."""
        self.next += n
        return range(self.next - n, self.next)


def token_counts(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of whole texts: words, or the tokens of a tokenizer file (.json) that every executor can read."""

    def count(batch):
        if tokenizer_path:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(tokenizer_path)
            t.encode_special_tokens = True
            n = [len(x.ids) for x in t.encode_batch(pc.fill_null(batch.column(1), "").to_pylist(), add_special_tokens=False)]
        else:
            n = np.concatenate([np.diff(words(data, offs)[2]) for _, _, data, offs in texts(batch.column(1))])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), count, "doc_id bigint, n_tokens bigint")


def _sharded(counts: DataFrame, shards: int, hot_rows: int) -> DataFrame:
    """counts (doc_id, n_tokens, row) with its shard: by hash of id and length, and of the row where these are the same for more than hot_rows rows."""
    key = [F.col("doc_id"), F.col("n_tokens")]
    hot = counts.groupBy("doc_id", "n_tokens").count().filter(F.col("count") > hot_rows)
    if not hot.head(1):
        return counts.withColumn("shard", F.pmod(F.xxhash64(*key), F.lit(shards)).cast("int"))
    hot = hot.select(F.col("doc_id").alias("d"), F.col("n_tokens").alias("n"), F.ceil(F.col("count") / hot_rows).alias("spread"))
    both = counts.join(hot, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("n_tokens") == F.col("n")), "left")
    salt = F.when(F.col("spread").isNotNull(), F.pmod(F.xxhash64("row"), "spread")).otherwise(0)
    return both.withColumn("shard", F.pmod(F.xxhash64(*key, salt), F.lit(shards)).cast("int")).select("doc_id", "n_tokens", "shard")


def pack(docs: DataFrame, window: int = WINDOW, shard_windows: int = SHARD_WINDOWS, tokenizer_path: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(shard, window, offset, doc_id, piece, start, n_tokens): where each document's tokens go.

    Documents are spread by hash over shards of about shard_windows windows, a number that
    follows the corpus; each shard is packed online in the order of (doc_id, n_tokens), null ids
    last. A document longer than a window fills whole windows first and its rest is placed like
    any other. Null, empty and wordless texts take no place. Repeated rows are placed each; where
    one id (or none) and one length have more than hot_rows rows, these are spread over shards by
    row. An empty table gives no rows; other columns, of whatever name, are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    counts = scratch.save(token_counts(docs, tokenizer_path).filter("n_tokens > 0").withColumn("row", F.monotonically_increasing_id()))
    total = counts.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    shards = max(1, -(-total // (window * shard_windows)))
    schema = "shard int, window bigint, offset int, doc_id bigint, piece int, start bigint, n_tokens int"

    def one(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["doc_id"].to_pylist(), table["n_tokens"].to_pylist()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        packer, out = Packer(window), []
        for doc_id, n in rows:
            full, rest = divmod(n, window)
            for piece, at in enumerate(packer.whole(full)):
                out.append((at, 0, doc_id, piece, piece * window, window))
            if rest:
                at, offset = packer.place(rest)
                out.append((at, offset, doc_id, full, full * window, rest))
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
        cols = [pa.array(c, t) for c, t in zip(zip(*out), types)]
        return pa.Table.from_arrays([pa.array([table["shard"][0].as_py()] * len(out), pa.int32()), *cols], ["shard", "window", "offset", "doc_id", "piece", "start", "n_tokens"])

    # one shard to a task: the shards are the parallelism, and each is of bounded size
    return _sharded(counts, shards, hot_rows).drop("row").groupBy("shard").applyInArrow(one, schema)

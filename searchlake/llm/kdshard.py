"""Sharding by a K-d tree over document metadata, split at distributed weighted medians."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..errors import InvalidParam
from ..operators.mutations import number_rows
from .common import Scratch, quoted

TARGET_BYTES, BINS, MAX_DEPTH = 128 << 20, 4096, 60
#: Up to this size the ranks of a dimension's values are broadcast; beyond it they are joined by shuffle.
MAX_BROADCAST_BYTES = 16 << 20
DIMENSIONS = ("lang", "source", "n_chars", "doc_id")


def _ranked(rows: DataFrame, column: str, scratch: Scratch, max_broadcast: int) -> DataFrame:
    """rows with a column's values replaced by their rank, from 1, among its distinct values; null by 0."""
    values = rows.filter(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    ranks = scratch.save(number_rows(values, "value", "rank").select("value", F.col("rank").cast("double").alias("rank")))
    size = ranks.agg(F.coalesce(F.sum(F.octet_length(F.col("value").cast("string")) + 24), F.lit(0))).first()[0]
    joined = rows.join(F.broadcast(ranks) if size <= max_broadcast else ranks, F.col(column) == F.col("value"), "left")
    return joined.withColumn(column, F.coalesce("rank", F.lit(0.0))).drop("value", "rank")


def coordinates(rows: DataFrame, n: int, scratch: Scratch, max_broadcast: int) -> DataFrame:
    """rows with d0 .. dn-1 as doubles that keep the order of the values, null below all of them.

    Whole numbers count from the smallest, so that ids far from zero stay apart; other values,
    and whole numbers too far apart for a double, are replaced by their rank.
    """
    whole = [k for k in range(n) if isinstance(rows.schema[f"d{k}"].dataType, T.IntegralType)]
    ends = rows.agg(F.lit(0), *[f(f"d{k}").cast("decimal(20,0)").alias(f"{name}{k}") for k in whole for f, name in ((F.min, "min"), (F.max, "max"))]).first()
    for k in range(n):
        low, high = (ends[f"min{k}"], ends[f"max{k}"]) if k in whole else (None, None)
        if k in whole and (low is None or high - low < 1 << 52):
            shifted = F.col(f"d{k}").cast("decimal(20,0)") - F.lit(0 if low is None else low) + 1
            rows = rows.withColumn(f"d{k}", F.coalesce(shifted.cast("double"), F.lit(0.0)))
        else:
            rows = _ranked(rows, f"d{k}", scratch, max_broadcast)
    return rows


def shard(docs: DataFrame, target_bytes: int = TARGET_BYTES, dimensions: tuple = DIMENSIONS, bins: int = BINS, max_broadcast: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """(doc_id, shard, n_bytes): the leaf of the K-d tree in which each row falls.

    A node heavier than target_bytes (UTF-8 bytes of text) is split at the weighted median of the
    dimension that is widest in it, as a share of the whole table's width, of equal ones the first;
    rows at the median go left, unless nothing would then be right. Strings and other values that
    are no whole numbers count by their rank among the column's distinct values, whole values of
    any length. A node whose rows agree in every dimension is a leaf however heavy it is, so rows
    of equal metadata stay together; repeated rows are placed each. Null and empty texts weigh 0;
    a null in a dimension lies below all values, NaN above. Shards are numbered by their path: the
    children of n are 2n and 2n + 1; a tree deeper than MAX_DEPTH raises an error. An empty table
    gives no rows; other columns, of whatever name, are not looked at. Every level reads only the
    numbers of each row, never the texts.
    """
    scratch, n = Scratch(docs.sparkSession, "kd"), len(dimensions)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), *[c.alias(f"d{k}") for k, c in enumerate(quoted(dimensions))])
    rows = scratch.save(coordinates(scratch.save(rows), n, scratch, max_broadcast).withColumn("node", F.lit(1).cast("bigint")).withColumn("open", F.lit(True)))
    ends = [f(F.col(f"d{k}")).alias(f"{name}{k}") for k in range(n) for f, name in ((F.min, "min"), (F.max, "max"))]
    whole = rows.agg(*ends).first()
    width = [((whole[f"max{k}"] or 0) - (whole[f"min{k}"] or 0)) or 1.0 for k in range(n)]

    for depth in range(MAX_DEPTH + 1):
        heavy = rows.filter("open").groupBy("node").agg(F.sum("n_bytes").alias("w"), *ends).filter(F.col("w") > target_bytes)
        spans = F.array(*[(F.col(f"max{k}") - F.col(f"min{k}")) / width[k] for k in range(n)])
        heavy = heavy.withColumn("dim", F.array_position(spans, F.array_max(spans)).cast("int") - 1).filter(F.array_max(spans) > 0)
        end = [F.element_at(F.array(*[F.col(f"{name}{k}") for k in range(n)]), F.col("dim") + 1) for name in ("min", "max")]
        state = scratch.save(heavy.select("node", "dim", (F.col("w") / 2).alias("half"), end[1].alias("top"), end[0].alias("lo"), end[1].alias("hi"), F.lit(0.0).alias("below")))
        if not state.head(1):
            break
        if depth == MAX_DEPTH:
            raise InvalidParam(f"{target_bytes} bytes a shard make a tree deeper than {MAX_DEPTH}")
        value = F.element_at(F.array(*[F.col(f"d{k}") for k in range(n)]), F.col("dim") + 1)
        split = scratch.save(rows.filter("open").join(state.select("node", "dim"), "node").withColumn("v", value).select("node", "v", "n_bytes"))
        while state.filter("lo < hi").head(1):
            # the bin that holds the median becomes the next range, until it is one value
            step = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
            held = split.join(state.filter("lo < hi"), "node").filter("v >= lo AND v <= hi")
            hist = held.groupBy("node", step.alias("bin")).agg(F.sum("n_bytes").alias("w"), F.min("v").alias("a"), F.max("v").alias("b"), F.first("half").alias("half"), F.first("below").alias("below"), F.first("dim").alias("dim"), F.first("top").alias("top"))
            order = Window.partitionBy("node").orderBy("bin")
            hist = hist.withColumn("upto", F.col("below") + F.sum("w").over(order)).filter("upto >= half")
            hist = hist.withColumn("r", F.row_number().over(order)).filter("r = 1")
            next_state = hist.select("node", "dim", "half", "top", F.col("a").alias("lo"), F.col("b").alias("hi"), (F.col("upto") - F.col("w")).alias("below"))
            after = scratch.save(next_state.unionByName(state.filter("lo = hi")))
            scratch.drop(state)
            state = after
        cuts = state.select("node", "dim", F.col("lo").alias("cut"), (F.col("lo") == F.col("top")).alias("at_top"))
        right = F.when(F.col("at_top"), F.col("v") >= F.col("cut")).otherwise(F.col("v") > F.col("cut"))
        moved = rows.join(cuts, "node", "left").withColumn("v", value)
        moved = moved.withColumn("open", F.col("cut").isNotNull()).withColumn("node", F.when(F.col("open"), F.col("node") * 2 + right.cast("int")).otherwise(F.col("node")))
        after = scratch.save(moved.select(*rows.columns))
        for gone in (rows, split, state):
            scratch.drop(gone)
        rows = after
    return rows.select("doc_id", F.col("node").alias("shard"), "n_bytes")

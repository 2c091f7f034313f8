"""Ranking across results: facets, grouping, fusion of rankings, typo tolerance, suggestions, links, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RRF_K = 60


def facets(matches: DataFrame, field: str) -> DataFrame:
    """(value, n): how many matches have each value of a field."""
    return matches.groupBy(F.col(f"`{field}`").alias("value")).agg(F.count("*").alias("n"))


def group_top(matches: DataFrame, field: str, n: int = 1, order: Column | None = None, id_col: str = "_id") -> DataFrame:
    """The best n matches of each value of a field."""
    w = Window.partitionBy(field).orderBy(order if order is not None else F.desc("_score"), F.col(id_col))
    return matches.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def _top(df: DataFrame, column: str, depth: int, name: str, ascending: bool) -> DataFrame:
    """(id, name) with the rank of the best depth rows; the window sees no more than these."""
    order = F.col(column).asc() if ascending else F.col(column).desc()
    best = df.orderBy(order, "_id").limit(depth)
    return best.select("_id", F.row_number().over(Window.orderBy(order, "_id")).alias(name))


def reciprocal_rank_fusion(rankings: list[tuple[DataFrame, str, bool]], depth: int = 100, k: int = RRF_K) -> DataFrame:
    """(_id, _score): the sum of 1 / (k + rank) over rankings, each (rows, column, ascending) cut at depth."""
    parts = [_top(df, column, depth, "rank", ascending).select("_id", (F.lit(1.0) / (F.col("rank") + k)).alias("s")) for df, column, ascending in rankings]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("_id").agg(F.sum("s").alias("_score"))


def weighted_fusion(text: DataFrame, vector: DataFrame, text_weight: float = 0.7, vector_weight: float = 0.3) -> DataFrame:
    """(_id, _score): weighted sum of two score columns; a missing score counts 0."""
    joined = text.select("_id", F.col("_score").alias("t")).join(vector.select("_id", F.col("_score").alias("v")), "_id", "full_outer")
    return joined.select("_id", (text_weight * F.coalesce("t", F.lit(0.0)) + vector_weight * F.coalesce("v", F.lit(0.0))).alias("_score"))


def merge_spaces(spaces: list[tuple[str, DataFrame]], snake: bool = True) -> DataFrame:
    """(space, _id, _score, rank) of several collections' results: in turns by rank, or by score."""
    both = None
    for k, (name, df) in enumerate(spaces):
        own = df.select(F.lit(name).alias("space"), F.lit(k).alias("__k"), F.col("_id").cast("bigint").alias("_id"), "_score")
        both = own if both is None else both.unionByName(own)
    if snake:
        w = Window.partitionBy("__k").orderBy(F.desc("_score"), "_id")
        both = both.withColumn("rank", F.row_number().over(w)).orderBy("rank", "__k")
    else:
        both = both.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("_score"), "__k", "_id"))).orderBy("rank")
    return both.select("space", "_id", "_score", "rank")


def near_terms(vocabulary: DataFrame, word: str, distance: int = 1) -> DataFrame:
    """(token, df) of a vocabulary within an edit distance of a word; lengths prune before distances."""
    size = F.length("token")
    return vocabulary.filter(size.between(len(word) - distance, len(word) + distance)).filter(F.levenshtein("token", F.lit(word)) <= distance)


def suggest(vocabulary: DataFrame, prefix: str, n: int = 10) -> DataFrame:
    """The most frequent n tokens that begin with a prefix."""
    return vocabulary.filter(F.col("token").startswith(prefix)).orderBy(F.desc("df"), "token").limit(n)


def traverse(sources: DataFrame, edges: DataFrame, targets: DataFrame, source_key: str, edge_source: str, edge_target: str, target_key: str) -> DataFrame:
    """One hop along links: source, edge and target columns."""
    return sources.join(edges, F.col(source_key) == F.col(edge_source)).join(targets, F.col(edge_target) == F.col(target_key))


def chunks(df: DataFrame, id_col: str, text_col: str, size: int = 200, overlap: int = 50) -> DataFrame:
    """(id, chunk, text): windows of size words that overlap; the last one ends the text."""
    step = size - overlap
    tokens = df.select(id_col, F.filter(F.split(text_col, r"\s+"), lambda t: t != "").alias("t")).filter("size(t) > 0")
    last = F.greatest(F.lit(0), F.ceil((F.size("t") - size) / F.lit(step))).cast("int")
    each = tokens.select(id_col, "t", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    return each.select(id_col, "chunk", F.array_join(F.slice("t", F.col("chunk") * step + 1, F.lit(size)), " ").alias("text"))


def last_turns(turns: DataFrame, conversation: str, order: str, n: int) -> DataFrame:
    """The last n turns of every conversation."""
    w = Window.partitionBy(conversation).orderBy(F.desc(order))
    return turns.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= n)


def change_messages(messages: DataFrame, edits: DataFrame | None = None, removed: DataFrame | None = None, key: tuple[str, ...] = ("conv_id", "turn")) -> DataFrame:
    """Messages after those of edits were added, or put in the place of the ones of their key, and those of the keys in removed were taken away."""
    out = messages
    if edits is not None:
        out = out.join(edits.select(*key), list(key), "left_anti").unionByName(edits)
    return out if removed is None else out.join(removed.select(*key), list(key), "left_anti")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres of points in degrees."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0088 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))

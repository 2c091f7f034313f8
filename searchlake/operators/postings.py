"""A full-text index as tables: postings with positions, document lengths, statistics.

The index pays off when one collection is queried often: a query reads the postings of its
tokens only. Each task writes the postings of its own texts in runs that are sorted by token, so
that a token filter skips most pages of each file; nothing is shuffled or sorted as a whole, and
the commonest tokens are in all files alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..batches import bounded
from ..functions.analysis import Analyzer
from ..plans.compiler import bm25, phrase_match

#: Tokens that are sorted at a time, about, and in a written run; a longer text is taken whole.
PIECE, RUN = 1 << 18, 1 << 20


def _pieces(size: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Consecutive rows (from, to) with about so many tokens in each, given the rows' numbers of tokens."""
    cuts = np.flatnonzero(np.diff((np.cumsum(size) - size) // most)) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(size)]))


def doc_lengths(df: DataFrame, field: str, analyzer: Analyzer = Analyzer(), id_col: str = "_id") -> DataFrame:
    """(_id, dl): the token counts of the texts that have tokens."""
    return df.select(F.col(id_col).alias("_id"), F.size(analyzer.tokens(F.col(f"`{field}`"))).alias("dl")).filter("dl > 0")


def _sorted(b: pa.RecordBatch, by_token: bool):
    """The postings of a batch (_id, tokens), sorted by text or by token."""
    lists = b.column(1)
    size, flat = np.diff(lists.offsets.to_numpy()), lists.flatten()
    if not len(flat):
        return
    row, first = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
    coded = flat.dictionary_encode()
    code = coded.indices.to_numpy()
    if by_token:
        rank = np.empty(len(coded.dictionary), np.int64)
        rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
        key = rank[code] * len(size) + row
    else:
        key = row * len(coded.dictionary) + code
    order = np.argsort(key, kind="stable")  # so that positions stay in order
    start = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
    ends, at = np.append(start, len(order)).astype(np.int32), row[order[start]]
    places = pa.ListArray.from_arrays(pa.array(ends), pa.array((order - first[row[order]]).astype(np.int32)))
    cols = [b.column(0).take(pa.array(at)), coded.dictionary.take(pa.array(code[order[start]])), pa.array(np.diff(ends)), places, pa.array(size[at].astype(np.int32))]
    yield pa.RecordBatch.from_arrays(cols, ["_id", "token", "tf", "positions", "dl"])


def postings(df: DataFrame, field: str, analyzer: Analyzer = Analyzer(), id_col: str = "_id", by_token: bool = False) -> DataFrame:
    """(_id, token, tf, positions, dl), one row for each token of each text: all of a text's tokens are in its row, so nothing is shuffled.

    by_token: in runs sorted by token.
    """
    tokens = df.select(F.col(id_col).alias("_id"), analyzer.tokens(F.col(f"`{field}`")).alias("t")).filter("size(t) > 0")

    def run(batches):
        for b in batches:
            for lo, hi in _pieces(np.diff(b.column(1).offsets.to_numpy()), RUN if by_token else PIECE):
                yield from _sorted(b.slice(lo, hi - lo), by_token)

    schema = T.StructType([tokens.schema["_id"], *T.StructType.fromDDL("token string, tf int, positions array<int>, dl int").fields])
    return bounded(tokens).mapInArrow(run, schema)


def document_frequencies(posts: DataFrame) -> DataFrame:
    """(token, df): in how many records each token occurs."""
    return posts.groupBy("token").agg(F.count("*").alias("df"))


def write(df: DataFrame, field: str, path: str, analyzer: Analyzer = Analyzer(), id_col: str = "_id", buckets: int | None = None) -> None:
    """Write a text field's postings, in runs sorted by token, and the lengths of its texts; buckets: files, if not as many as tasks."""
    rows = postings(df if buckets is None else df.repartition(buckets), field, analyzer, id_col, by_token=True)
    rows.write.mode("overwrite").parquet(f"{path}/postings")
    # each text has one token at position 0, so that no text is tokenised again
    made = df.sparkSession.read.schema(rows.schema).parquet(f"{path}/postings")
    made.filter(F.col("positions")[0] == 0).select("_id", "dl").write.mode("overwrite").parquet(f"{path}/lengths")


@dataclass
class PostingsIndex:
    """A text field's index. build() writes it; open() reads one or several that were written, of disjoint records."""

    posts: DataFrame
    stats: DataFrame
    analyzer: Analyzer

    @classmethod
    def build(cls, df: DataFrame, field: str, path: str, analyzer: Analyzer = Analyzer(), id_col: str = "_id", buckets: int | None = None) -> PostingsIndex:
        write(df, field, path, analyzer, id_col, buckets)
        return cls.open(df.sparkSession, [path], analyzer)

    @classmethod
    def open(cls, spark: SparkSession, paths: str | list[str], analyzer: Analyzer = Analyzer(), deleted: DataFrame | None = None) -> PostingsIndex:
        """deleted: the _ids that count no more, in no statistic either."""
        paths = [paths] if isinstance(paths, str) else paths
        posts, lengths = (spark.read.parquet(*[f"{p}/{kind}" for p in paths]) for kind in ("postings", "lengths"))
        if deleted is not None:
            posts, lengths = (df.join(deleted.select("_id"), "_id", "left_anti") for df in (posts, lengths))
        return cls(posts, lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")), analyzer)

    def vocabulary(self) -> DataFrame:
        """(token, df), from the postings alone."""
        return document_frequencies(self.posts)

    def _hits(self, tokens: list[str]) -> DataFrame:
        return self.posts.filter(F.col("token").isin(tokens))

    def _scored(self, hits: DataFrame, tokens: list[str], boost: float) -> DataFrame:
        """(_id, _score) of the hits' records over the distinct tokens."""
        freq = F.broadcast(hits.groupBy("token").agg(F.count("*").alias("df")))  # a row for each query token
        each = hits.join(freq, "token").crossJoin(F.broadcast(self.stats))
        score = bm25(F.col("tf"), F.col("df"), F.col("n"), F.col("dl"), F.col("total") / F.col("n"))
        return each.groupBy("_id").agg((F.sum(score) * boost).alias("_score"), F.collect_set("token").alias("found"))

    def text(self, query: str, operator: str = "or", boost: float = 1.0) -> DataFrame:
        """(_id, _score) of the records with any, or every, token of the query."""
        groups = self.analyzer.expand(query)
        tokens = list(dict.fromkeys(t for g in groups for t in g))
        if not tokens:
            return self.posts.select("_id", F.lit(0.0).alias("_score")).limit(0)
        out = self._scored(self._hits(tokens), tokens, boost)
        if operator == "and":
            for g in groups:
                out = out.filter(F.arrays_overlap("found", F.array(*[F.lit(t) for t in g])))
        return out.select("_id", "_score")

    def phrase(self, query: str, slop: int = 0, boost: float = 1.0) -> DataFrame:
        """(_id, _score) of the records with the phrase."""
        groups = self.analyzer.expand(query)
        tokens = list(dict.fromkeys(t for g in groups for t in g))
        if not tokens:
            return self.posts.select("_id", F.lit(0.0).alias("_score")).limit(0)
        hits = self._hits(tokens)
        places = [F.array_sort(F.flatten(F.collect_list(F.when(F.col("token").isin(g), F.col("positions"))))).alias(f"p{k}") for k, g in enumerate(groups)]
        own = hits.groupBy("_id").agg(*places)
        for k in range(len(groups)):
            own = own.filter(F.size(f"p{k}") > 0)
        found = own.filter(phrase_match([F.col(f"p{k}") for k in range(len(groups))], slop)).select("_id")
        return self._scored(hits, tokens, boost).join(found, "_id", "left_semi").select("_id", "_score")

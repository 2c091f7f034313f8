"""Facets, grouping, fusion, typo tolerance, suggestions, links, conversations, chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.analysis import Analyzer
from ..operators import postings, ranking
from ..plans import parser
from ..plans.compiler import Compiler
from .base import collection, query, read
from .text import TOKENS, bm25_sql
from .vector import METRIC_SQL, Q

NEAR = f"(SELECT vec_id AS _id, round({METRIC_SQL['euclidean']}, 6) AS d FROM embeddings, {Q})"


def _text_hits(spark, sf_dir, words="ther thth"):
    hits = collection(spark, sf_dir, "documents").matches(parser.parse_where(f"text = text('{words}')"))
    return hits.select(F.col("doc_id").alias("_id"), F.round("_score", 6).alias("_score"), "lang")


def _vector_hits(spark, sf_dir):
    df = read(spark, sf_dir, "embeddings")
    q = df.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    return df.crossJoin(F.broadcast(q)).select(F.col("vec_id").alias("_id"), F.round(vectors.distance(F.col("embedding"), F.col("q")), 6).alias("d"))


@query("SELECT o_orderpriority AS value, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def facet_counts(spark, sf_dir):
    return ranking.facets(collection(spark, sf_dir, "orders").matches(parser.parse_where("o_orderstatus = 'F'")), "o_orderpriority")


@query(f"""SELECT lang, doc_id, _score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT lang, doc_id, round(_score, 6) AS _score, row_number() OVER (PARTITION BY lang ORDER BY round(_score, 6) DESC, doc_id) AS rank FROM ({bm25_sql(['ther', 'thth'])}) JOIN documents USING (doc_id)) WHERE rank <= 2""")
def group_top1(spark, sf_dir):
    """The best two hits of each language."""
    return ranking.group_top(_text_hits(spark, sf_dir), "lang", 2).select("lang", F.col("_id").alias("doc_id"), "_score", "rank")


@query(f"""WITH t AS (SELECT doc_id AS _id, row_number() OVER (ORDER BY round(_score, 6) DESC, doc_id) AS r FROM ({bm25_sql(['ther', 'thth'])})),
  v AS (SELECT _id, row_number() OVER (ORDER BY d, _id) AS r FROM {NEAR})
  SELECT _id, round(sum(1.0 / (60 + r)), 9) AS _score FROM (SELECT * FROM t WHERE r <= 100 UNION ALL SELECT * FROM v WHERE r <= 100) GROUP BY _id""")
def hybrid_rrf(spark, sf_dir):
    """Reciprocal ranks of a text and a vector ranking, added up."""
    fused = ranking.reciprocal_rank_fusion([(_text_hits(spark, sf_dir), "_score", False), (_vector_hits(spark, sf_dir), "d", True)])
    return fused.select("_id", F.round("_score", 9).alias("_score"))


@query(f"""SELECT _id, round(0.7 * coalesce(t._score, 0) + 0.3 * coalesce(v._score, 0), 6) AS _score
  FROM (SELECT doc_id AS _id, round(_score, 6) AS _score FROM ({bm25_sql(['ther', 'thth'])})) t FULL JOIN (SELECT _id, 1 / (1 + d) AS _score FROM {NEAR}) v USING (_id)""")
def hybrid_weighted(spark, sf_dir):
    """Text and vector scores, weighted 0.7 and 0.3."""
    near = _vector_hits(spark, sf_dir).select("_id", (1 / (1 + F.col("d"))).alias("_score"))
    return ranking.weighted_fusion(_text_hits(spark, sf_dir), near).select("_id", F.round("_score", 6).alias("_score"))


def _vocabulary(spark, sf_dir):
    tokens = read(spark, sf_dir, "documents").select(F.explode(F.array_distinct(Analyzer().tokens(F.col("text")))).alias("token"))
    return postings.document_frequencies(tokens)


VOCABULARY = f"(SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS token FROM (SELECT {TOKENS.format('text')} AS t FROM documents)) GROUP BY token)"


@query(f"SELECT token, df FROM {VOCABULARY} WHERE levenshtein(token, 'thereon') <= 1")
def typo_terms(spark, sf_dir):
    """Words of the vocabulary within one edit of a word."""
    return ranking.near_terms(_vocabulary(spark, sf_dir), "thereon", 1)


@query(f"SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS token FROM documents) WHERE token IN (SELECT token FROM {VOCABULARY} WHERE levenshtein(token, 'thereon') <= 1)")
def typo_search(spark, sf_dir):
    """Documents with any word within one edit of a word."""
    near = ranking.near_terms(_vocabulary(spark, sf_dir), "thereon", 1).select("token")
    tokens = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(Analyzer().tokens(F.col("text")))).alias("token"))
    return tokens.join(near, "token", "left_semi").select("doc_id").distinct()


@query(f"SELECT token, df FROM {VOCABULARY} WHERE starts_with(token, 'ther') ORDER BY df DESC, token LIMIT 10")
def suggest_prefix(spark, sf_dir):
    return ranking.suggest(_vocabulary(spark, sf_dir), "ther", 10)


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 5000")
def link_traverse(spark, sf_dir):
    """Two hops along links, from matching customers to regions."""
    hits = collection(spark, sf_dir, "customer").matches(parser.parse_where("c_acctbal > 5000"))
    out = ranking.traverse(hits, read(spark, sf_dir, "nation"), read(spark, sf_dir, "region"), "c_nationkey", "n_nationkey", "n_regionkey", "r_regionkey")
    return out.select("c_custkey", "n_name", "r_name")


@query(f"""WITH d AS (SELECT 'documents' AS space, 0 AS k, doc_id AS _id, round(_score, 6) AS _score FROM ({bm25_sql(['ther', 'ndon'])})),
  p AS (SELECT 'pages' AS space, 1 AS k, page_id AS _id, round(_score, 6) AS _score FROM ({bm25_sql(['ther', 'ndon'], 'pages', 'page_id', 'html')}))
  SELECT space, _id, _score, CAST(row_number() OVER (PARTITION BY k ORDER BY _score DESC, _id) AS INTEGER) AS rank FROM (SELECT * FROM d UNION ALL SELECT * FROM p)""")
def multi_space_merge(spark, sf_dir):
    """Two collections' hits, taken in turns."""
    docs = _text_hits(spark, sf_dir, "ther ndon")
    pages = Compiler(read(spark, sf_dir, "pages"), "page_id", {"html": Analyzer()}).matches(parser.parse_where("html = text('ther ndon')"))
    pages = pages.select(F.col("page_id").alias("_id"), F.round("_score", 6).alias("_score"))
    return ranking.merge_spaces([("documents", docs), ("pages", pages)])


@query("SELECT conv_id, turn, role, text, CAST(back AS INTEGER) AS back FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 2")
def conv_last_turns(spark, sf_dir):
    return ranking.last_turns(read(spark, sf_dir, "conversations"), "conv_id", "turn", 2).select("conv_id", "turn", "role", "text", "back")


@query(r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS t FROM documents),
  c AS (SELECT doc_id, t, unnest(range(CAST(greatest(0, ceil((len(t) - 200) / 150.0)) AS BIGINT) + 1)) AS chunk FROM t WHERE len(t) > 0)
  SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, array_to_string(list_slice(t, chunk * 150 + 1, chunk * 150 + 200), ' ') AS text FROM c""")
def chunk_docs(spark, sf_dir):
    """Windows of 200 words that overlap by 50."""
    return ranking.chunks(read(spark, sf_dir, "documents"), "doc_id", "text", 200, 50)

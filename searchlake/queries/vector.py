"""Vector metrics, exact and approximate neighbours."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import graph_index, vector_index
from ..plans.compiler import Compiler
from ..plans.parser import parse
from ..scratch import shared_dir
from .base import query, read

Q = "(SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)"
V = "CAST(embedding AS DOUBLE[])"
DOT = f"list_sum(list_transform(list_zip({V}, q), lambda z: z[1] * z[2]))"
NORM = "sqrt(list_sum(list_transform({}, lambda x: x * x)))"
COS = f"{DOT} / ({NORM.format(V)} * {NORM.format('q')})"
METRIC_SQL = {
    "euclidean": f"list_sum(list_transform(list_zip({V}, q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))",
    "manhattan": f"list_sum(list_transform(list_zip({V}, q), lambda z: abs(z[1] - z[2])))",
    "dot": f"-({DOT})",
    "cosine": f"-({COS})",
    "angular": f"2 - 2 * ({COS})",
}


def _embeddings(spark, sf_dir):
    return read(spark, sf_dir, "embeddings")


def _asked(spark, sf_dir):
    """Every vector with the query vector, the one of id 0, beside it."""
    df = _embeddings(spark, sf_dir)
    q = df.filter("vec_id = 0").select(F.col("embedding").alias("q"))
    return df.crossJoin(F.broadcast(q))


def _metric(metric: str) -> None:
    sql = f"SELECT vec_id, round(d, 6) + 0.0 AS distance FROM (SELECT vec_id, {METRIC_SQL[metric]} AS d FROM embeddings, {Q}) ORDER BY round(d, 6), vec_id LIMIT 20"

    def run(spark, sf_dir):
        d = F.round(vectors.distance(F.col("embedding"), F.col("q"), metric), 6) + 0.0  # no negative zero
        return _asked(spark, sf_dir).select("vec_id", d.alias("distance")).orderBy("distance", "vec_id").limit(20)

    query(sql, f"knn_{metric}")(run)


for _m in vectors.METRICS:
    _metric(_m)


@query(f"SELECT vec_id, label, round(d, 6) AS distance FROM (SELECT vec_id, label, {METRIC_SQL['euclidean']} AS d FROM embeddings, {Q} WHERE label IN (1, 3) AND vec_id <> 0) ORDER BY round(d, 6), vec_id LIMIT 15")
def knn_filtered(spark, sf_dir):
    """Filtered before it is ranked, by the records' own ids and fields."""
    d = F.round(vectors.distance(F.col("embedding"), F.col("q")), 6)
    return _asked(spark, sf_dir).filter("label IN (1, 3) AND vec_id <> 0").select("vec_id", "label", d.alias("distance")).orderBy("distance", "vec_id").limit(15)


@query(f"SELECT vec_id, round(list_sum(list_transform(list_zip(({V})[9:24], q[9:24]), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS distance FROM embeddings, {Q}")
def range_metric(spark, sf_dir):
    """A metric over dimensions 8 to 23 only."""
    return _asked(spark, sf_dir).select("vec_id", F.round(vectors.range_distance(F.col("embedding"), F.col("q"), 8, 24), 6).alias("distance"))


@query(f"SELECT vec_id, round({NORM.format(V)}, 6) AS norm, CAST(len(embedding) AS INTEGER) AS dim FROM embeddings")
def vector_norm(spark, sf_dir):
    return _embeddings(spark, sf_dir).select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"), F.size("embedding").alias("dim"))


@query("SELECT vec_id, label FROM embeddings WHERE len(embedding) = 64")
def vector_dim_check(spark, sf_dir):
    return _embeddings(spark, sf_dir).filter(vectors.is_valid(F.col("embedding"), 64)).select("vec_id", "label")


@query("SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0")
def vector_valid(spark, sf_dir):
    return _embeddings(spark, sf_dir).filter(vectors.is_valid(F.col("embedding"))).select("vec_id")


@query(f"SELECT vec_id, round(list_sum({V}), 4) AS total FROM embeddings")
def parse_vector(spark, sf_dir):
    """Vectors by way of their JSON text."""
    parsed = vectors.parse_vector(F.to_json("embedding"))
    total = F.aggregate(parsed.cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return _embeddings(spark, sf_dir).select("vec_id", F.round(total, 4).alias("total"))


def _literal_query(spark, sf_dir, metric: str, k: int, where: str = ""):
    q = _embeddings(spark, sf_dir).filter("vec_id = 0").first()["embedding"]
    text = f"SELECT vec_id FROM embeddings WHERE {where}embedding = knn('{[float(x) for x in q]}', k={k}, metric={metric}) ORDER BY _score ASC LIMIT {k}"
    return Compiler(_embeddings(spark, sf_dir), "vec_id").search(parse(text)).select("vec_id", F.round("_score", 6).alias("_score"))


@query(f"SELECT vec_id, round(d, 6) AS _score FROM (SELECT vec_id, {METRIC_SQL['euclidean']} AS d FROM embeddings, {Q}) ORDER BY d, vec_id LIMIT 10")
def sql_knn(spark, sf_dir):
    """knn as a predicate of the dialect."""
    return _literal_query(spark, sf_dir, "euclidean", 10)


@query(f"SELECT vec_id, round(d + 1, 6) AS _score FROM (SELECT vec_id, {METRIC_SQL['manhattan']} AS d FROM embeddings, {Q} WHERE label = 2) ORDER BY d, vec_id LIMIT 8")
def sql_knn_filtered(spark, sf_dir):
    return _literal_query(spark, sf_dir, "manhattan", 8, "label = 2 AND ")


@query(f"SELECT vec_id, round(2.5 * d, 6) AS _score FROM (SELECT vec_id, {METRIC_SQL['euclidean']} AS d FROM embeddings, {Q} WHERE label < 5) ORDER BY d, vec_id LIMIT 12")
def vector_search_boost(spark, sf_dir):
    """Filter, rank, and score by distance times boost."""
    d = vectors.distance(F.col("embedding"), F.col("q"))
    return _asked(spark, sf_dir).filter("label < 5").select("vec_id", d.alias("d")).orderBy("d", "vec_id").limit(12).select("vec_id", F.round(F.col("d") * 2.5, 6).alias("_score"))


@query(f"""
  SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, distance FROM (
    SELECT a.vec_id AS query_id, b.vec_id, round({METRIC_SQL['euclidean'].replace(V, 'CAST(a.embedding AS DOUBLE[])').replace(', q)', ', CAST(b.embedding AS DOUBLE[]))')}, 6) AS distance,
           row_number() OVER (PARTITION BY a.vec_id ORDER BY round({METRIC_SQL['euclidean'].replace(V, 'CAST(a.embedding AS DOUBLE[])').replace(', q)', ', CAST(b.embedding AS DOUBLE[]))')}, 6), b.vec_id) AS rank
    FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id) WHERE rank <= 5""")
def knn_graph(spark, sf_dir):
    """The five nearest others of every vector, by exact distances rounded to six digits."""
    near = vector_index.knn_graph(_embeddings(spark, sf_dir), 5, "vec_id", "embedding", digits=6)
    return near.select("query_id", F.col("_id").alias("vec_id"), "rank", "distance")


@query(f"SELECT label, pos, round(avg(x), 6) AS mean FROM (SELECT label, unnest({V}) AS x, CAST(unnest(range(len(embedding))) AS INTEGER) AS pos FROM embeddings) GROUP BY label, pos")
def centroid_by_label(spark, sf_dir):
    each = _embeddings(spark, sf_dir).select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "x"))
    return each.groupBy("label", "pos").agg(F.round(F.avg("x"), 6).alias("mean"))


def _named(spark, sf_dir):
    """All vectors, and as queries those whose id is divisible by 50."""
    df = _embeddings(spark, sf_dir).select(F.col("vec_id").alias("_id"), F.col("embedding").alias("vector"), "label")
    return df, df.filter("_id % 50 = 0").select(F.col("_id").alias("query_id"), "vector")


PAIRS = METRIC_SQL["euclidean"].replace(V, "CAST(a.embedding AS DOUBLE[])").replace(", q)", ", CAST(b.embedding AS DOUBLE[]))")


def _flat_sql(where: str = "true") -> str:
    return f"""SELECT query_id, _id, CAST(rank AS INTEGER) AS rank, distance FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, _id) AS rank FROM (
        SELECT a.vec_id AS query_id, b.vec_id AS _id, round({PAIRS}, 6) AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND {where})) WHERE rank <= 10"""


@query(_flat_sql())
def flat_search(spark, sf_dir):
    """The ten nearest of all vectors, exactly, by distances rounded to six digits."""
    df, queries = _named(spark, sf_dir)
    return vector_index.FlatIndex(df, "_id", "vector").search(queries, 10, digits=6)


@query(_flat_sql("b.label IN (1, 3)"))
def flat_search_filtered(spark, sf_dir):
    """The same among the vectors of two labels, filtered before they are ranked."""
    df, queries = _named(spark, sf_dir)
    return vector_index.FlatIndex(df, "_id", "vector").search(queries, 10, where="label IN (1, 3)", digits=6)


@query()
def ivf_search(spark, sf_dir):
    df, queries = _named(spark, sf_dir)
    return vector_index.IvfIndex.build(df, cells=16, copies=2).search(queries, 10, probes=8)


@query()
def pq_search(spark, sf_dir):
    df, queries = _named(spark, sf_dir)
    return vector_index.IvfIndex.build(df, cells=1, subspaces=4, bits=4).search(queries, 10, probes=1)


@query()
def ivfpq_search(spark, sf_dir):
    df, queries = _named(spark, sf_dir)
    return vector_index.IvfIndex.build(df, cells=8, subspaces=4, bits=4, copies=3).search(queries, 10, probes=4)


@query()
def lsh_search(spark, sf_dir):
    df, queries = _named(spark, sf_dir)
    return vector_index.lsh_search(df, queries, 10)


@query()
def hnsw_search(spark, sf_dir):
    df, queries = _named(spark, sf_dir)
    return graph_index.GraphIndex.build(df, kind="hnsw").search(queries, 10)


@query()
def hnsw_search_filtered(spark, sf_dir):
    """Filtered inside the walk: points of other labels lead on, but are not found."""
    df, queries = _named(spark, sf_dir)
    return graph_index.GraphIndex.build(df, kind="hnsw").search(queries, 10, allowed=df.filter("label IN (1, 3)"))


@query()
def hnsw_search_deleted(spark, sf_dir):
    """A graph that was saved and opened again, without the vectors of one label, which are deleted after it was built."""
    df, queries = _named(spark, sf_dir)
    path = f"{shared_dir(spark)}/searchlake-hnsw-{uuid.uuid4().hex[:12]}"
    graph_index.GraphIndex.build(df, kind="hnsw").save(path)
    return graph_index.GraphIndex.load(spark, path).search(queries, 10, deleted=df.filter("label = 2"))


@query()
def ivfpq_search_filtered(spark, sf_dir):
    """Codes that were saved and opened again, among the vectors of five labels."""
    df, queries = _named(spark, sf_dir)
    path = f"{shared_dir(spark)}/searchlake-ivfpq-{uuid.uuid4().hex[:12]}"
    vector_index.IvfIndex.build(df, cells=8, subspaces=4, bits=4, copies=3).save(path)
    return vector_index.IvfIndex.load(spark, path).search(queries, 10, probes=4, allowed=df.filter("label < 5"))


@query()
def ssg_search(spark, sf_dir):
    df, queries = _named(spark, sf_dir)
    return graph_index.GraphIndex.build(df, kind="ssg").search(queries, 10)


@query()
def hnsw_recall(spark, sf_dir):
    """The share of the true ten nearest that the graph finds."""
    df, queries = _named(spark, sf_dir)
    truth = vector_index.FlatIndex(df, "_id", "vector").search(queries, 10).select("query_id", "_id")
    found = graph_index.GraphIndex.build(df, kind="hnsw").search(queries, 10).select("query_id", "_id", F.lit(1.0).alias("hit"))
    return truth.join(found, ["query_id", "_id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))


@query()
def kmeans_assign(spark, sf_dir):
    df, _ = _named(spark, sf_dir)
    return vector_index.kmeans(df, 10)[1]


@query()
def kmeans_medoid(spark, sf_dir):
    df, _ = _named(spark, sf_dir)
    return vector_index.medoids(df, 10)

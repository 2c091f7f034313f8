"""Collections on disk: records loaded through changes, searched by their own indexes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..collection import Collection
from ..operators import ranking
from ..scratch import shared_dir
from ..types import Field, FieldType, Schema, VectorOption
from .base import query, read
from .rank import VOCABULARY
from .text import _phrase_sql, bm25_sql, rounded
from .vector import METRIC_SQL, Q

SCHEMAS = {
    "documents": Schema.of("documents", Field("doc_id", FieldType.INT), Field("lang", FieldType.STRING), Field("text", FieldType.TEXT)),
    "embeddings": Schema.of("embeddings", Field("vec_id", FieldType.INT), Field("label", FieldType.INT), Field("embedding", FieldType.VECTOR, vector=VectorOption(64))),
    "customer": Schema.of("customer", Field("c_custkey", FieldType.INT), Field("c_acctbal", FieldType.FLOAT)),
}
INDEXED = {"documents": "text", "embeddings": "embedding"}
_loaded: dict[tuple, Collection] = {}


def batch(df: DataFrame, action: str, key: str, prefix: str) -> DataFrame:
    """Rows as actions on records named by their key."""
    return df.select(F.col(key).cast("bigint").alias("_seq"), F.lit(action).alias("_action"), F.concat(F.lit(prefix), F.col(key)).alias("_name"), F.to_json(F.struct(*df.columns)).alias("_data"))


def fresh(spark, sf_dir: str, table: str, key: str, fields: list[str]) -> Collection:
    """A new collection of all rows of a driver table, indexed where INDEXED says so."""
    own = Catalog(spark, f"{shared_dir(spark)}/searchlake-stored-{uuid.uuid4().hex[:12]}").create(SCHEMAS[table])
    if table in INDEXED:
        own.build_index(INDEXED[table])
    own.mutate(batch(read(spark, sf_dir, table).select(*fields), "append", key, f"{table}-"))
    return own


def loaded(spark, sf_dir: str, table: str, key: str, fields: list[str]) -> Collection:
    """The same, made once for all queries of a session."""
    at = (spark.sparkContext.applicationId, sf_dir, table)
    if at not in _loaded:
        _loaded[at] = fresh(spark, sf_dir, table, key, fields)
    return _loaded[at]


def documents(spark, sf_dir: str) -> Collection:
    return loaded(spark, sf_dir, "documents", "doc_id", ["doc_id", "lang", "text"])


def _hits(c: Collection, where: str) -> DataFrame:
    return c.search(where, ["doc_id"], limit=1 << 30).select("doc_id", F.round("_score", 6).alias("_score"))


@query(rounded(bm25_sql(["ther", "thth", "ndon"])))
def collection_text(spark, sf_dir):
    """A text query answered from a collection's postings."""
    return _hits(documents(spark, sf_dir), "text = text('ther thth ndon')")


@query(_phrase_sql("of", "the", 2))
def collection_phrase(spark, sf_dir):
    """A phrase with slop, from the positions in the postings."""
    return _hits(documents(spark, sf_dir), "text = phrase('of the', slop=2)")


@query(f"SELECT doc_id, round(_score + 1, 6) AS _score FROM ({bm25_sql(['ther', 'thth'])}) JOIN documents USING (doc_id) WHERE lang = 'en' ORDER BY round(_score + 1, 6) DESC, doc_id LIMIT 10")
def collection_hybrid_topk(spark, sf_dir):
    """Text and structure on a collection, the ten best."""
    hits = _hits(documents(spark, sf_dir), "text = text('ther thth') AND lang = 'en'")
    return hits.orderBy(F.desc("_score"), "doc_id").limit(10)


@query(f"SELECT doc_id, round(_score, 6) AS _score FROM ({bm25_sql(['ther', 'thth'])}) ORDER BY round(_score, 6) DESC, doc_id LIMIT 10")
def collection_bm25_topk(spark, sf_dir):
    """The ten best by BM25 on postings."""
    return _hits(documents(spark, sf_dir), "text = text('ther thth')").orderBy(F.desc("_score"), "doc_id").limit(10)


@query(f"SELECT vec_id, round(d, 5) AS distance FROM (SELECT vec_id, {METRIC_SQL['euclidean']} AS d FROM embeddings, {Q} WHERE label < 5) ORDER BY d, vec_id LIMIT 12")
def collection_knn(spark, sf_dir):
    """A vector query on a collection: its graph proposes, exact distances decide."""
    c = loaded(spark, sf_dir, "embeddings", "vec_id", ["vec_id", "label", "embedding"])
    q = [float(x) for x in read(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"]]
    return c.search(f"label < 5 AND embedding = knn('{q}', k=12)", ["vec_id"], limit=12).select("vec_id", F.round(F.col("_score") - 1, 5).alias("distance"))


@query(f"SELECT token, df FROM {VOCABULARY} WHERE starts_with(token, 'ther') ORDER BY df DESC, token LIMIT 10")
def collection_suggest(spark, sf_dir):
    """Suggestions from a collection's postings, of which only tokens are read."""
    return documents(spark, sf_dir).suggest("text", "ther", 10)


@query(f"SELECT token, df FROM {VOCABULARY} WHERE levenshtein(token, 'thereon') <= 1")
def collection_typo_terms(spark, sf_dir):
    """Words of a collection's postings within one edit of a word."""
    return documents(spark, sf_dir).near_terms("text", "thereon", 1)


def _customers(spark, sf_dir) -> Collection:
    """All customers, then an upsert of the even ones with more money and a delete of those divisible by three."""
    c = fresh(spark, sf_dir, "customer", "c_custkey", ["c_custkey", "c_acctbal"])
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    action = F.when(F.col("c_custkey") % 3 == 0, "delete").when(F.col("c_custkey") % 2 == 0, "upsert").otherwise("none")
    more = batch(rows.withColumn("c_acctbal", F.col("c_acctbal") + 100), "none", "c_custkey", "customer-").withColumn("_action", F.lit(None))
    acts = rows.select(F.col("c_custkey").cast("bigint").alias("k"), action.alias("a"))
    c.mutate(more.join(acts, F.col("_seq") == F.col("k")).filter("a <> 'none'").select("_seq", F.col("a").alias("_action"), "_name", "_data"))
    return c


@query("SELECT c_custkey, round(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 100 ELSE c_acctbal END, 4) AS bal FROM customer WHERE c_custkey % 3 <> 0")
def collection_changes(spark, sf_dir):
    """Every customer appended, then upserted, deleted or left alone, and the whole compacted."""
    c = _customers(spark, sf_dir)
    c.persist()
    return c.scan().select("c_custkey", F.round(F.get_json_object("_data", "$.c_acctbal").cast("double"), 4).alias("bal"))


@query("SELECT c_custkey, round(c_acctbal + 100, 4) AS bal FROM customer WHERE c_custkey = 4")
def collection_get(spark, sf_dir):
    """The latest record of a name, after it was replaced."""
    found = _customers(spark, sf_dir).get("customer-4")
    return found.select(F.get_json_object("_data", "$.c_custkey").cast("bigint").alias("c_custkey"), F.round(F.get_json_object("_data", "$.c_acctbal").cast("double"), 4).alias("bal"))


@query("""SELECT n, n_deleted FROM (SELECT count(*) FILTER (WHERE c_custkey % 3 <> 0 AND c_custkey % 2 <> 0) AS n, count(*) FILTER (WHERE c_custkey % 3 = 0 OR c_custkey % 2 = 0) AS n_deleted FROM customer)
  UNION ALL SELECT count(*), 0 FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 2 = 0""")
def collection_info(spark, sf_dir):
    """Live and deleted records by segment."""
    return _customers(spark, sf_dir).info().select("n", "n_deleted")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey >= 10")
def collection_add_field(spark, sf_dir):
    """A field indexed after the records were written, then queried, and another one dropped."""
    c = fresh(spark, sf_dir, "customer", "c_custkey", ["c_custkey", "c_acctbal", "c_nationkey"])
    c.add_field(Field("c_nationkey", FieldType.INT))
    c.drop_field("c_acctbal")
    return c.search("c_nationkey >= 10", ["c_custkey", "c_nationkey"], limit=1 << 30).select("c_custkey", "c_nationkey")


@query("SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN concat(text, ' (edited)') ELSE text END AS text FROM conversations WHERE role <> 'system'")
def conv_crud(spark, sf_dir):
    """Messages of all conversations added, those of one role edited and those of another removed."""
    own = read(spark, sf_dir, "conversations")
    edits = own.filter("role = 'assistant'").withColumn("text", F.concat("text", F.lit(" (edited)")))
    return ranking.change_messages(own, edits, own.filter("role = 'system'")).select("conv_id", "turn", "role", "text")


@query("""SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(2 * 6371.0088 * asin(sqrt(least(1.0,
    pow(sin(radians((b.n_nationkey * 5 - 60) - (a.n_nationkey * 5 - 60)) / 2), 2) + cos(radians(a.n_nationkey * 5 - 60)) * cos(radians(b.n_nationkey * 5 - 60)) * pow(sin(radians(b.n_nationkey * 13 - a.n_nationkey * 13) / 2), 2)))), 3) AS km
  FROM nation a, nation b WHERE a.n_nationkey = 0""")
def geo_distance(spark, sf_dir):
    """Great-circle distances from one point to all others, on made-up coordinates."""
    n = read(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 5.0 - 60).alias("lat"), (F.col("n_nationkey") * 13.0).alias("lon"))
    a = n.filter("n_nationkey = 0").select(F.col("n_nationkey").alias("a"), F.col("lat").alias("lat0"), F.col("lon").alias("lon0"))
    km = ranking.haversine_km(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon"))
    return n.crossJoin(F.broadcast(a)).select("a", F.col("n_nationkey").alias("b"), F.round(km, 3).alias("km"))

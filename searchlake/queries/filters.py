"""Scans, predicates, boolean algebra and its scores, order and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import parser
from ..plans.ir import Between, Search, Term
from .base import SOURCES, collection, dialect, matching, query, read

ORDER = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"
PART = "p_partkey, p_name, p_size"


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_all(spark, sf_dir):
    """SELECT * without a predicate: every live record."""
    return collection(spark, sf_dir, "customer").matches(None).drop("_score")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_name = (SELECT c_name FROM customer WHERE c_custkey = 42) ORDER BY c_custkey DESC LIMIT 1")
def get_by_name(spark, sf_dir):
    """The latest record of a name."""
    df = read(spark, sf_dir, "customer")
    name = df.filter("c_custkey = 42").select(F.col("c_name").alias("n"))
    return df.join(F.broadcast(name), F.col("c_name") == F.col("n")).orderBy(F.desc("c_custkey")).limit(1).select("c_custkey", "c_name", "c_acctbal")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77")
def get_by_id(spark, sf_dir):
    return read(spark, sf_dir, "orders").filter("o_orderkey = 77").select("o_orderkey", "o_custkey", "o_totalprice")


matching("filter_eq_str", "orders", "o_orderpriority = '1-URGENT'", ORDER, "o_orderpriority = '1-URGENT'")
matching("filter_eq_int", "part", "p_size = 15", PART, "p_size = 15")
matching("filter_eq_float", "orders", "o_totalprice = 1000.5", ORDER, "o_totalprice = 1000.5")
matching("filter_ne", "labelled", "quality != 1", "doc_id, lang, quality", "quality IS DISTINCT FROM 1")
matching("filter_lt", "part", "p_size < 10", PART, "p_size < 10")
matching("filter_le", "part", "p_size <= 10", PART, "p_size <= 10")
matching("filter_gt", "orders", "o_totalprice > 250000.5", ORDER, "o_totalprice > 250000.5")
matching("filter_ge", "labelled", "quality >= 0", "doc_id, quality", "quality >= 0")
matching("filter_between", "orders", "o_totalprice BETWEEN 1000 AND 90000", ORDER, "o_totalprice BETWEEN 1000 AND 90000")
matching("filter_not_between", "part", "p_size NOT BETWEEN 5 AND 45", PART, "p_size NOT BETWEEN 5 AND 45")
matching("filter_in", "customer", "c_mktsegment IN ('BUILDING', 'MACHINERY')", "c_custkey, c_mktsegment", "c_mktsegment IN ('BUILDING', 'MACHINERY')")
matching("filter_not_in", "customer", "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')", "c_custkey, c_mktsegment", "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
matching("filter_bool", "labelled", "good = 'true'", "doc_id, quality", "good")
matching("filter_and", "orders", "o_orderstatus = 'F' AND o_totalprice > 100000 AND o_orderpriority != '5-LOW'", ORDER, "o_orderstatus = 'F' AND o_totalprice > 100000 AND o_orderpriority <> '5-LOW'")
matching("filter_or", "orders", "o_totalprice < 20000 OR o_orderpriority = '2-HIGH'", ORDER, "o_totalprice < 20000 OR o_orderpriority = '2-HIGH'")
matching("filter_nested", "orders", "(o_orderstatus = 'O' OR o_orderstatus = 'P') AND (o_totalprice < 50000 OR o_totalprice >= 300000)", ORDER, "o_orderstatus IN ('O', 'P') AND (o_totalprice < 50000 OR o_totalprice >= 300000)")
matching("filter_not", "labelled", "NOT (quality = 1 OR lang = 'en')", "doc_id, lang", "NOT coalesce(quality = 1, false) AND NOT lang = 'en'")
matching("filter_array_ne", "part", "words != 'green'", PART, "NOT list_contains(words, 'green')")
matching("filter_array_range", "part", "words > 't'", PART, "len(list_filter(words, lambda w: w > 't')) > 0")
matching("filter_array_in", "part", "words IN ('green', 'small', 'blue')", PART, "list_has_any(words, ['green', 'small', 'blue'])")


@query(f"SELECT {PART} FROM {SOURCES['part']} WHERE list_contains(words, (SELECT string_split(p_name, ' ')[1] FROM part WHERE p_partkey = 1))")
def filter_array_contains(spark, sf_dir):
    """A list field equals what any of its elements is."""
    c = collection(spark, sf_dir, "part")
    word = c.df.filter("p_partkey = 1").first()["words"][0]
    return c.matches(Term("words", word)).select(*PART.split(", "))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice = (SELECT o_totalprice FROM orders WHERE o_orderkey = 7)")
def filter_eq_float_found(spark, sf_dir):
    """Equality of floats with a value that is there."""
    c = collection(spark, sf_dir, "orders")
    price = c.df.filter("o_orderkey = 7").first()["o_totalprice"]
    return c.matches(Term("o_totalprice", price)).select("o_orderkey", "o_totalprice")


@query(f"SELECT {PART} FROM part WHERE p_size >= 10 AND p_size < 20")
def filter_between_half_open(spark, sf_dir):
    """A range with its lower bound in and its upper bound out."""
    return collection(spark, sf_dir, "part").matches(Between("p_size", 10, True, 20, False)).select(*PART.split(", "))


matching("project_cols", "customer", "c_acctbal > 0", "c_name, c_acctbal", "c_acctbal > 0")
SCORED = "o_orderkey, _score"
matching("score_boost", "orders", "o_totalprice > score(300000, boost=3)", SCORED, "SELECT o_orderkey, 3.0::DOUBLE AS _score FROM orders WHERE o_totalprice > 300000")
matching("score_and", "orders", "o_orderstatus = 'F' AND o_orderpriority = score('1-URGENT', boost=2.5)", SCORED, "SELECT o_orderkey, 3.5::DOUBLE AS _score FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
matching("score_or", "orders", "o_orderstatus = 'F' OR o_orderpriority = score('1-URGENT', boost=2.5)", SCORED, "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END::DOUBLE + CASE WHEN o_orderpriority = '1-URGENT' THEN 2.5 ELSE 0.0 END::DOUBLE AS _score FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'")

dialect("project_alias", "customer", "SELECT c_custkey AS id, c_name AS who FROM customer ORDER BY c_custkey LIMIT 1000000", "id, who", "SELECT c_custkey AS id, c_name AS who FROM customer ORDER BY c_custkey LIMIT 1000000")
dialect("topk_sorted", "orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC LIMIT 25", "o_orderkey, o_totalprice", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
dialect("limit_default", "orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'", "o_orderkey", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 10")
dialect("limit_offset", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice LIMIT 20 OFFSET 30", "o_orderkey, o_totalprice", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20 OFFSET 30")
dialect("limit_comma", "orders", "SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 LIMIT 5, 15", "o_orderkey", "SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 ORDER BY o_orderkey LIMIT 15 OFFSET 5")
dialect("sort_score", "orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus = score('F', boost=5) OR o_orderpriority = '1-URGENT' ORDER BY _score DESC LIMIT 40", "o_orderkey, _score", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 5.0 ELSE 0.0 END::DOUBLE + CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.0 END::DOUBLE AS _score FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '1-URGENT' ORDER BY _score DESC, o_orderkey LIMIT 40")


def _sorted(spark, sf_dir, table, order, columns):
    """All records with their place in the order, so that the order itself is compared."""
    from pyspark.sql.window import Window

    c = collection(spark, sf_dir, table)
    df = c.matches(None)
    place = F.row_number().over(Window.partitionBy(*order[1]).orderBy(*c.order_columns(order[0]))).cast("bigint")
    return df.select(*columns, place.alias("place"))


@query("SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal ASC NULLS FIRST, c_custkey) AS place FROM customer")
def sort_asc(spark, sf_dir):
    return _sorted(spark, sf_dir, "customer", ([("c_acctbal", True)], ["c_mktsegment"]), ["c_custkey", "c_mktsegment"])


@query("SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS place FROM customer")
def sort_desc(spark, sf_dir):
    return _sorted(spark, sf_dir, "customer", ([("c_acctbal", False)], ["c_mktsegment"]), ["c_custkey", "c_mktsegment"])


@query(f"SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY quality ASC NULLS FIRST, n_chars DESC NULLS LAST, doc_id) AS place FROM {SOURCES['labelled']}")
def sort_multi(spark, sf_dir):
    """Missing values sort first."""
    return _sorted(spark, sf_dir, "labelled", ([("quality", True), ("n_chars", False)], ["lang"]), ["doc_id", "lang"])


@query("SELECT count(*) AS total_hits FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 200000")
def total_hits(spark, sf_dir):
    return collection(spark, sf_dir, "orders").total_hits(parser.parse_where("o_orderstatus = 'F' AND o_totalprice < 200000"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'F' ORDER BY o_custkey DESC, o_totalprice ASC, o_orderkey LIMIT 20 OFFSET 10")
def search_api(spark, sf_dir):
    """A query given in parts: predicate, order, offset, limit, fields."""
    order = parser.parse_order(["o_custkey desc", "o_totalprice,asc"])
    where = parser.parse_where("o_totalprice > 1000 AND o_orderstatus = 'F'")
    fields = tuple((f, f) for f in ("o_orderkey", "o_custkey", "o_totalprice"))
    return collection(spark, sf_dir, "orders").search(Search(where, fields, order, 10, 20)).drop("_score")


@query("SELECT c_custkey, CAST(to_json({c_custkey: c_custkey, c_name: c_name, c_acctbal: c_acctbal, _score: 1.0::DOUBLE}) AS VARCHAR) AS json FROM customer WHERE c_acctbal > 5000")
def result_json(spark, sf_dir):
    """Hits as JSON objects."""
    hits = collection(spark, sf_dir, "customer").matches(parser.parse_where("c_acctbal > 5000"))
    return hits.select("c_custkey", F.to_json(F.struct("c_custkey", "c_name", "c_acctbal", "_score")).alias("json"))

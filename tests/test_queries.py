"""Every registered query of the search engine against its SQL in DuckDB, on the smallest tables."""

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest

from searchlake.queries import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    """A value in a form in which both engines write it alike."""
    if v is None or v != v:
        return "null"
    if isinstance(v, dict):
        v = list(v.values())
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.8g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted("|".join(plain(r[k]) for k in order) for r in values)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, tables, name):
    df = QUERIES[name](spark, str(DATA))
    cur = tables.execute(ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, cur.fetchall())


def test_every_query_has_sql_or_a_reason():
    without = {"analyze_stem", "tokenize_uax29", "ivf_search", "pq_search", "ivfpq_search", "ivfpq_search_filtered", "lsh_search", "hnsw_search", "hnsw_search_filtered", "hnsw_search_deleted", "ssg_search", "hnsw_recall", "kmeans_assign", "kmeans_medoid"}
    assert set(QUERIES) - set(ORACLE_SQL) == without


#: Words that a query's comparison must leave in PushedFilters; labelled is a join, of which each side gets its own.
PUSHED = {
    "filter_eq_str": ["EqualTo(o_orderpriority,1-URGENT)"], "filter_eq_int": ["EqualTo(p_size,15)"], "filter_eq_float": ["EqualTo(o_totalprice,1000.5)"],
    "filter_lt": ["LessThan(p_size,10)"], "filter_le": ["LessThanOrEqual(p_size,10)"], "filter_gt": ["GreaterThan(o_totalprice,250000.5)"], "filter_ge": ["GreaterThanOrEqual(quality,0)"],
    "filter_between": ["GreaterThanOrEqual(o_totalprice", "LessThanOrEqual(o_totalprice"], "filter_not_between": ["LessThan(p_size,5)", "GreaterThan(p_size,45)"], "filter_between_half_open": ["GreaterThanOrEqual(p_size,10)", "LessThan(p_size,20)"],
    "filter_in": ["In(c_mktsegment"], "filter_not_in": ["Not(In(c_mktsegment"], "filter_bool": ["EqualTo(quality,1)"],
    "filter_and": ["EqualTo(o_orderstatus,F)", "GreaterThan(o_totalprice", "Not(EqualTo(o_orderpriority,5-LOW))"], "filter_or": ["Or(LessThan(o_totalprice", "EqualTo(o_orderpriority,2-HIGH)"],
    "filter_nested": ["EqualTo(o_orderstatus,O)", "LessThan(o_totalprice"], "filter_not": ["Not(EqualTo(lang,en))"], "score_boost": ["GreaterThan(o_totalprice"], "score_and": ["EqualTo(o_orderstatus,F)"], "score_or": ["Or(EqualTo(o_orderstatus,F)"],
    "topk_sorted": ["EqualTo(o_orderstatus,O)"], "limit_comma": ["GreaterThan(o_totalprice"], "total_hits": ["EqualTo(o_orderstatus,F)", "LessThan(o_totalprice"], "search_api": ["GreaterThan(o_totalprice", "EqualTo(o_orderstatus,F)"],
    "facet_counts": ["EqualTo(o_orderstatus,F)"], "text_and_filter": ["EqualTo(lang,en)", "GreaterThan(n_chars,500)"], "hybrid_topk": ["EqualTo(lang,en)"], "link_traverse": ["GreaterThan(c_acctbal"],
}


@pytest.mark.parametrize("name", sorted(PUSHED))
def test_predicates_reach_the_scan(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    pushed = " ".join(line[line.index("PushedFilters:") :] for line in plan.splitlines() if "PushedFilters:" in line)
    assert all(word in pushed for word in PUSHED[name]), pushed


def test_texts_are_tokenised_once_for_each_side(spark):
    plan = QUERIES["text_or"](spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2 * plan.count("inline(") / plan.count("inline(")

"""Collections, the dialect, storage, streaming and indexes by themselves."""

import json
import math
import os
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from searchlake import batches
from searchlake.catalog import Catalog
from searchlake.errors import DecodeError, InvalidParam, NotExisted, NotSupported, StorageError
from searchlake.functions import analysis
from searchlake.functions.analysis import Analyzer, segments
from searchlake.functions.stemmer import stem
from searchlake.functions.vectors import split_imbalance
from searchlake.operators import graph_index, mutations, postings, vector_index
from searchlake.operators.graph_index import Hnsw, Ssg
from searchlake.operators.postings import PostingsIndex
from searchlake.operators.ranking import haversine_km
from searchlake.operators.vector_index import FlatIndex, IvfIndex, distances
from searchlake.plans import parser
from searchlake.plans.compiler import Compiler
from searchlake.plans.ir import And, Between, InList, Not, Or, Phrase, Term, Text
from searchlake.queries import QUERIES
from searchlake.scratch import shared_dir
from searchlake.sources.dictionary import load_synonyms, load_words
from searchlake.streaming.ingest import ingest
from searchlake.types import Field, FieldType, Schema, TextOption, VectorOption

SCHEMA = Schema.of("people", Field("name", FieldType.STRING), Field("age", FieldType.INT), Field("skill", FieldType.STRING, array=True), Field("about", FieldType.TEXT))


@pytest.fixture
def people(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}").create(SCHEMA)
    rows = [("append", f"user{i}", {"name": f"user{i}", "age": 20 + i % 10, "skill": ["java", "rust"] if i % 2 else ["go"], "about": f"user {i} likes the hello world number {i}"}) for i in range(20)]
    c.mutate(c.actions(rows))
    return c


def test_precedence_and_literals():
    q = parser.parse("SELECT name, age AS years FROM t WHERE a = 1 OR b >= -2.5 AND NOT (c IN ('x', 'it''s') OR d BETWEEN 1 AND 3) ORDER BY age DESC, _SCORE LIMIT 5, 7")
    assert isinstance(q.where, Or) and isinstance(q.where.right, And) and isinstance(q.where.right.right, Not)
    inner = q.where.right.right.child
    assert inner == Or(InList("c", ("x", "it's"), False), Between("d", 1, True, 3, True, False))
    assert q.where.left == Term("a", 1, False, 1.0)
    assert (q.fields, q.order, q.offset, q.limit) == ((("name", "name"), ("age", "years")), (("age", False), ("_score", True)), 5, 7)


def test_functions_of_the_dialect():
    assert parser.parse_where("a = text('x y', boost=2, operator=and)") == Text("a", "x y", "and", 2.0)
    assert parser.parse_where("a = phrase('x y', slop=3)") == Phrase("a", "x y", 3, 1.0)
    assert parser.parse_where("") is None
    for bad in ("a =", "a == 1", "a > text('x')", "a = nothing('x')", "a NOT = 1", "(a = 1", "a = 1 b = 2", "a = text('x', slop=1)"):
        with pytest.raises(InvalidParam):
            parser.parse_where(bad)


def test_search_pages_and_totals(people):
    assert people.total_hits("age >= 25 and skill = 'go'") == 4
    got = people.sql("SELECT name FROM people WHERE age < 23 ORDER BY age DESC LIMIT 2 OFFSET 1").collect()
    assert [r["name"] for r in got] == ["user12", "user1"]
    assert people.search("about = phrase('hello world')", limit=100).count() == 20
    assert people.search("about = phrase('world hello')").count() == 0


def test_changes_and_compaction(people):
    assert people.mutate_json("insert", "user1", {"age": 1}) != 0
    assert people.mutate_json("upsert", "user1", {"age": 99, "name": "user1"}) == 0
    assert people.mutate_json("delete", "user2", "") == 0
    assert people.mutate_json("delete", "user2", "") != 0
    assert people.mutate_json("append", "bad", "{no json") != 0
    before = sorted(map(tuple, people.raw().collect()))
    people.persist()
    assert sorted(map(tuple, people.raw().collect())) == before and len(before) == 19
    assert json.loads(people.get("user1").first()["_data"])["age"] == 99
    assert people.storage.manifest()["tombstones"] == []


def test_stream_is_applied_once(spark, people, tmp_path):
    source = str(tmp_path / "in")
    people.actions([("upsert", "fresh", {"age": 1}), ("append", "other", {"age": 2})]).write.parquet(source)
    for k in range(2):
        q = ingest(spark.readStream.schema("_seq bigint, _action string, _name string, _data string").parquet(source), people, f"file://{tmp_path}/state{k}")
        q.awaitTermination()
    # the second run starts from nothing, but the marker knows the batch
    assert people.total_hits(None) == 22 and people.marker("ingest") == "0"


def test_postings_score_as_the_compiler_does(spark, tmp_path):
    df = spark.createDataFrame([(1, "red fox and red hen"), (2, "a fox"), (3, "the hen"), (4, ""), (5, None)], "_id bigint, t string")
    index, scan = PostingsIndex.build(df, "t", f"file://{tmp_path}/p"), Compiler(df, "_id", {"t": Analyzer()})
    for where, got in (("t = text('red hen')", index.text("red hen")), ("t = text('red hen', operator=and)", index.text("red hen", "and")), ("t = phrase('red hen')", index.phrase("red hen"))):
        want = {r["_id"]: round(r["_score"], 9) for r in scan.matches(parser.parse_where(where)).collect()}
        assert {r["_id"]: round(r["_score"], 9) for r in got.collect()} == want


def test_analysis():
    assert Analyzer(TextOption(stopwords=("the",), stemmer="english")).analyze("The Ponies RUNNING") == [stem("ponies"), stem("running")]
    assert segments("can't stop, 3.14!") == ["can't", "stop", "3.14"]
    assert Analyzer(TextOption(synonyms=(("car", "auto"),))).expand("car") == [["car", "auto"]]


def test_vector_indexes_agree_with_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "_id bigint, vector array<double>")
    queries = df.limit(20).withColumnRenamed("_id", "query_id")
    ids = [r["query_id"] for r in queries.collect()]
    exact = {i: set(np.argsort(distances(x[[i]], x, "euclidean")[0])[:5].tolist()) for i in ids}

    def recall(found):
        return sum(r["_id"] in exact[r["query_id"]] for r in found.collect()) / (5 * len(ids))

    assert recall(FlatIndex(df).search(queries, 5)) == 1
    assert recall(IvfIndex.build(df, cells=8).search(queries, 5, probes=8)) == 1


FILTERS = {"hnsw_search_filtered": lambda label: label in (1, 3), "hnsw_search_deleted": lambda label: label != 2, "ivfpq_search_filtered": lambda label: label < 5}


@pytest.mark.parametrize("name", ["ivf_search", "pq_search", "ivfpq_search", "lsh_search", "hnsw_search", "ssg_search", *FILTERS])
def test_registered_recall(spark, name):
    """Recall@10 of the registered parameters, against brute force over every row; graphs, which take longer to build, on fewer."""
    data = "/root/testdata/sf0.01" if name.startswith("hnsw") else "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    asked = [(r[0], np.array(r[1], float)) for r in rows if r[0] % 50 == 0]
    rows = [r for r in rows if FILTERS.get(name, lambda label: True)(r[2])]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    exact = {i: set(ids[np.argsort(distances(v[None], x, "euclidean")[0])[:10]].tolist()) for i, v in asked}
    found = [(r["query_id"], r["_id"]) for r in QUERIES[name](spark, data).collect()]
    assert {a for a, _ in found} == {a for a, _ in asked}
    assert len(set(found)) == len(found) == 10 * len(asked)
    assert {b for _, b in found} <= set(ids.tolist())
    assert sum(b in exact[a] for a, b in found) / len(found) >= 0.9


def test_filtered_walk_finds_what_few_points_allow():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 8))
    g = Hnsw.build(np.arange(1500), x)
    hits = total = 0
    for share in (0.002, 0.05, 0.5):
        allowed = rng.random(1500) < share
        for q in rng.normal(size=(20, 8)):
            own = np.flatnonzero(allowed)
            want = own[np.argsort(((x[own] - q) ** 2).sum(axis=1))[:5]].tolist()
            got = [j for _, j in g.search(q, 5, 50, allowed)]
            assert allowed[got].all() and len(got) == len(want)
            hits, total = hits + len(set(got) & set(want)), total + len(want)
    assert hits / total > 0.95


def test_two_writers_of_one_version(people):
    other = type(people)(people.spark, people.storage.path)
    m = other.storage.manifest()
    assert people.mutate_json("append", "late", {"age": 1}) == 0
    with pytest.raises(StorageError):
        other.storage.put_manifest({**m, "version": m["version"] + 1})
    assert people.total_hits(None) == 21


def test_loading_spares_a_writer_at_work(spark, people):
    root = people.storage.path.rpartition("/")[0]
    begun = people.storage.write_segment(people.raw(), "records")  # in no manifest yet
    again = Catalog(spark, root).load("people")
    assert people.storage.files.exists(f"{people.storage.path}/{begun}") and again.storage.sweep() == []
    assert again.storage.sweep(grace=-1.0) == [begun]
    assert again.total_hits(None) == 20


def test_rolls_and_frees(people):
    for k in range(3):
        people.mutate_json("upsert", "user1", {"age": 50 + k})
    assert not people.roll(max_segments=10) and people.roll(max_segments=3)
    assert len(people.storage.manifest()["segments"]) == 1 and people.total_hits(None) == 20
    assert people.storage.sweep(grace=-1.0, keep=1) and people.total_hits("age = 52") == 1
    assert not people.roll(max_segments=3, max_age=0.0)


def test_two_streams_keep_their_own_markers(spark, people, tmp_path):
    schema = "_seq bigint, _action string, _name string, _data string"
    for name in ("one", "two"):
        people.actions([("append", name, {"age": 1})]).write.parquet(str(tmp_path / name))
    for run, name in enumerate(("one", "two", "one")):  # the third replays the first's only batch
        ingest(spark.readStream.schema(schema).parquet(str(tmp_path / name)), people, f"file://{tmp_path}/state{run}", name).awaitTermination()
        people.mutate(people.actions([("append", "x", {"age": 2})]), "other")
    assert people.total_hits("age = 1") == 2 and people.marker("one") == people.marker("two") == "0" and people.marker() == "other"


def test_workers_elsewhere_can_import_the_package(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__
print("rows", __spark_entry__.queries()["postings_build"](spark, "/root/testdata/sf0.001").count())
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert "rows" in done.stdout, done.stderr[-2000:]


def test_shared_folder_is_required_on_clusters():
    class Context:
        master = "spark://host:7077"
        _jsc = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False)))

    with pytest.raises(StorageError):
        shared_dir(SimpleNamespace(conf={}, sparkContext=Context()))


def test_indexes_follow_changes(spark, tmp_path):
    schema = Schema.of("notes", Field("n", FieldType.INT), Field("t", FieldType.TEXT), Field("v", FieldType.VECTOR, vector=VectorOption(2)))
    c = Catalog(spark, f"file://{tmp_path}").create(schema)
    c.build_index("t")
    c.mutate(c.actions([("append", f"a{k}", {"n": k, "t": f"red fox {'and hen ' * (k % 3)}{k}", "v": [float(k), 0.0]}) for k in range(12)]))
    c.build_index("v")
    c.mutate(c.actions([("upsert", "a1", {"n": 1, "t": "blue hen", "v": [0.4, 0.0]}), ("delete", "a2", ""), ("append", "bad", {"n": 9, "v": [1.0]})]))
    with pytest.raises(InvalidParam):
        c.build_index("n")
    scan = Compiler(c.scan(), "_id", c.analyzers())
    for where in ("t = text('red hen')", "t = text('red hen', operator=and)", "t = phrase('fox and', slop=1)", "t = 'hen' OR n > 9", "t = 'blue' AND n < 5", "NOT t = 'fox'"):
        want = {r["n"]: round(r["_score"], 9) for r in scan.matches(parser.parse_where(where)).collect()}
        for _ in range(2):
            assert {r["n"]: round(r["_score"], 9) for r in c.compiler().matches(parser.parse_where(where)).collect()} == want, where
    assert [r["n"] for r in c.search("v = knn('[0, 0]', k=3)", ["n"], ["_score asc"]).collect()] == [0, 1, 3]
    assert [r["n"] for r in c.search("n > 4 AND v = knn('[0, 0]', k=2)", ["n"], ["_score asc"]).collect()] == [5, 6]
    c.persist()
    assert {r["n"]: round(r["_score"], 9) for r in c.compiler().matches(parser.parse_where("NOT t = 'fox'")).collect()} == want
    assert [r["n"] for r in c.search("v = knn('[0, 0]', k=3)", ["n"], ["_score asc"]).collect()] == [0, 1, 3]
    got = c.sorted_hits("n < 3", ["n desc"]).collect()
    assert [r["_sort"] for r in got] == [["1", str(got[0]["_id"])], ["0", str(got[1]["_id"])]]
    assert c.ids_of(c.actions([("append", "a0", ""), ("append", "a2", "")])).select("_name").collect() == [("a0",)]


def test_several_vectors_in_a_record(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}").create(Schema.of("many", Field("n", FieldType.INT), Field("v", FieldType.VECTOR, array=True, vector=VectorOption(2))))
    got = c.mutate(c.actions([("append", "a", {"n": 1, "v": [[0, 0], [9, 9]]}), ("append", "b", {"n": 2, "v": [1, 1]}), ("append", "c", {"n": 3, "v": [[1, 2], [3]]}), ("append", "d", {"n": 4})]))
    assert [r["code"] for r in got.collect()] == [0, 0, 7, 0]
    assert [(r["n"], r["_score"]) for r in c.search("v = knn('[8, 9]', k=5)", ["n"], ["_score asc"]).collect()] == [(1, 1.0), (2, 113.0)]


def test_unnamed_records_are_apart(spark):
    batch = spark.createDataFrame([(k, "append", "", str(k)) for k in range(50)] + [(50, "upsert", "", "x"), (51, "delete", "", "")], "_seq bigint, _action string, _name string, _data string")
    done = mutations.apply_batch(spark.createDataFrame([(1, "", "old")], "_id bigint, _name string, _data string"), batch)
    assert [r["code"] for r in done.results.orderBy("_seq").collect()] == [0] * 51 + [3]
    assert done.added.count() == 51 and done.hidden.count() == 0
    assert "_seq" in done.results._jdf.queryExecution().optimizedPlan().toString().split("windowspecdefinition(")[1].split("ASC")[0]


def test_dictionaries_and_columns(spark, tmp_path):
    (tmp_path / "words").write_text("the\nof\n\nthe\n")
    assert load_words('["a", "b", "a"]') == ("a", "b") and load_words(str(tmp_path / "words"), "file") == ("the", "of")
    (tmp_path / "groups").write_text("car\tauto\nred\tcrimson\tscarlet\n")
    assert load_synonyms(str(tmp_path / "groups")) == (("car", "auto"), ("red", "crimson", "scarlet"))
    option = TextOption(stopwords=load_words(str(tmp_path / "words"), "file"), synonyms=load_synonyms(str(tmp_path / "groups")))
    assert Analyzer(option).expand("the car") == [["car", "auto"]]
    for bad in ("{", '"x"', "[1]"):
        with pytest.raises(DecodeError):
            load_words(bad)
    with pytest.raises(NotSupported):
        load_words("x", "http")
    row = spark.range(1).select(split_imbalance(F.lit(3), F.lit(1)), split_imbalance(F.lit(0), F.lit(0)), haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))).first()
    assert row[0] == 0.75 and row[1] == 1.0 and abs(row[2] - math.pi * 6371.0088) < 1e-6


def test_catalog_views(spark, people):
    root = people.storage.path.rpartition("/")[0]
    catalog = Catalog(spark, root)
    assert catalog.list() == ["people"]
    catalog.load("people").add_field(Field("extra", FieldType.STRING))
    catalog.view("people")
    assert spark.sql("SELECT count(*) FROM people WHERE age > 25 AND extra IS NULL").first()[0] == 8
    catalog.get("people").drop_field("extra")
    assert "extra" not in Catalog(spark, root).load("people").schema.fields
    catalog.release("people")
    with pytest.raises(NotExisted):
        catalog.get("people")


@pytest.mark.parametrize(("word", "root"), [("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("cries", "cri"), ("running", "run"), ("hopping", "hop"), ("hoped", "hope"), ("generalization", "general"), ("consisting", "consist"), ("knightly", "knight"), ("happy", "happi"), ("say", "say"), ("skies", "sky"), ("dying", "die"), ("exceedingly", "exceed"), ("national", "nation"), ("abilities", "abil"), ("relational", "relat"), ("conditional", "condit"), ("electrical", "electr"), ("hopefulness", "hope"), ("adjustment", "adjust"), ("controlling", "control"), ("rolls", "roll"), ("knots", "knot"), ("kneeling", "kneel"), ("knives", "knive")])
def test_stems_as_published(word, root):
    assert stem(word) == root


def test_saved_codes_are_ranked_alike(spark, tmp_path):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 8)))], "_id bigint, vector array<double>")
    queries = df.withColumnRenamed("_id", "query_id")
    index = IvfIndex.build(df, cells=4, subspaces=2, bits=4, copies=2)
    index.save(f"file://{tmp_path}/ivf")
    got = IvfIndex.load(spark, f"file://{tmp_path}/ivf").search(queries, 3, probes=2)
    # the distance is exact, so that every vector is nearest to itself
    assert got.filter("rank = 1 AND query_id = _id AND distance < 1e-9").count() == 300


def test_index_that_grows(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, [1.0]), (901, None)], "_id bigint, vector array<double>")
    queries = df.filter("_id % 50 = 0").withColumnRenamed("_id", "query_id")
    for parameters in ({}, {"subspaces": 4}):
        index = IvfIndex.build(df.filter("_id < 300 OR _id >= 900"), cells=4, copies=2, **parameters).add(df.filter("_id >= 300"))
        assert index.info() == {"n": 600, "dimension": 8, "cells": 4, "copies": 2, "subspaces": parameters.get("subspaces", 0)}
        got = {(r["query_id"], r["_id"]) for r in index.search(queries, 5, probes=4).collect()}
        want = {(i, j) for i in range(0, 600, 50) for j in np.argsort(((x - x[i]) ** 2).sum(axis=1))[:5].tolist()}
        assert len(got & want) / len(want) > 0.85


def test_postings_are_written_by_the_tasks_that_make_them(spark, tmp_path):
    """No exchange, whatever the shuffle partitions; runs are sorted by token, and lengths are those of the texts."""
    texts = [(i, " ".join(f"w{(i * 7 + j * j) % 50}" for j in range(i % 30))) for i in range(300)]
    df = spark.createDataFrame(texts, "_id bigint, t string").coalesce(1)
    postings.write(df, "t", f"file://{tmp_path}/p")
    assert len(list((tmp_path / "p/postings").glob("*.parquet"))) == 1
    made = spark.read.parquet(f"file://{tmp_path}/p/postings").collect()
    assert [(r["token"], r["_id"]) for r in made] == sorted((t, i) for i, text in texts for t in set(text.split()))
    lengths = spark.read.parquet(f"file://{tmp_path}/p/lengths").collect()
    assert sorted(map(tuple, lengths)) == [(i, len(text.split())) for i, text in texts if text]


def test_postings_are_made_in_pieces():
    assert postings._pieces(np.array([5, 5, 5, 40, 1, 0]), 10) == [(0, 2), (2, 4), (4, 6)]
    assert postings._pieces(np.zeros(0, int), 10) == [(0, 0)]


def test_few_queries_are_sent_instead_of_vectors(spark):
    """lsh: a vector is shuffled once, not once for each table and part; the ten nearest of those that share a bucket."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(600, 8)))], "_id bigint, vector array<double>")
    queries = df.limit(12).withColumnRenamed("_id", "query_id")
    assert vector_index.parts_for(queries, 1) == 1 and vector_index.slices_for(queries, 1, 1) == 8
    found = vector_index.lsh_search(df, queries, 10, tables=3)
    assert "posexplode" not in found._jdf.queryExecution().optimizedPlan().toString()
    exact = {(r["query_id"], r["_id"]): r["distance"] for r in FlatIndex(df).search(queries, 600).collect()}
    got = found.collect()
    assert got and all(abs(exact[r["query_id"], r["_id"]] - r["distance"]) < 1e-9 for r in got)
    assert {r["query_id"] for r in got if r["rank"] == 1 and r["_id"] == r["query_id"]} == {r["query_id"] for r in queries.collect()}


def test_blocks_come_in_bounded_batches(spark):
    """Blocks of 4096 vectors are megabytes each; ten thousand of them must not come to a worker at a time."""
    old = spark.conf.get(batches.CONF, None)
    spark.conf.unset(batches.CONF)
    try:
        df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(100)], "_id bigint, vector array<double>")
        IvfIndex.build(df, cells=1, subspaces=2, bits=2).search(df.limit(3).withColumnRenamed("_id", "query_id"), 2, probes=1)
        assert int(spark.conf.get(batches.CONF, None)) == batches.BATCH_BYTES
    finally:
        spark.conf.unset(batches.CONF) if old is None else spark.conf.set(batches.CONF, old)


def test_graphs_of_many_points_are_built_by_products():
    """A walk for each point took about 6 ms a point; the edges are bounded, and a walk finds the nearest."""
    rng = np.random.default_rng(8)
    for n in (0, 1, 2, 5, 3000):
        x = rng.normal(size=(n, 16))
        x[: n // 10] = x[0] if n else 0  # copies
        for kind in (Hnsw, Ssg):
            g = kind.build(np.arange(n), x)
            assert all(table.shape[0] == n and table.max(initial=-1) < n and not (table == np.arange(n)[:, None]).any() for table in g.layers)
            assert len(g.search(np.zeros(16), 10, 50)) == (min(n, 10) if n else 0)
            if n == 3000:
                asked = rng.normal(size=(30, 16))
                exact = np.argsort(distances(asked, x, "euclidean"), axis=1)[:, :10]
                assert sum(len({j for _, j in g.search(v, 10, 100)} & set(e.tolist())) for v, e in zip(asked, exact)) >= 0.95 * 300
    assert all(hasattr(graph_index, name) for name in ("_linked", "_before", "_diverse"))


def test_few_allowed_points_are_compared_for_all_queries_at_once(monkeypatch):
    rng = np.random.default_rng(9)
    x, asked = rng.normal(size=(3000, 8)), rng.normal(size=(20, 8))
    g = Hnsw.build(np.arange(3000), x)
    allowed = rng.random(3000) < 0.3
    monkeypatch.setattr(graph_index, "beam", None)  # no walk, which passes three points for each it finds
    own = np.flatnonzero(allowed)
    want = [own[np.argsort(((x[own] - v) ** 2).sum(axis=1))[:10]].tolist() for v in asked]
    assert [[j for _, j in found] for found in g.search_all(asked, 10, 100, allowed)] == want


def test_tokens_of_a_batch_are_made_in_pieces(spark):
    texts = ["a b", None, "", "can't stop, 3.14!"] * 50
    made = analysis._by_piece(pa.array(texts), segments)
    assert made.to_pylist() == [None if t is None else segments(t) for t in texts] and made.type == pa.list_(pa.string())
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i bigint, t string")
    got = df.select("i", Analyzer(TextOption("uax29", lowercase=False)).tokens(F.col("t")).alias("w")).orderBy("i").collect()
    assert [r["w"] for r in got] == made.to_pylist()

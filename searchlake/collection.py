"""A collection: named JSON records with indexed fields, searched and changed through DataFrames."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import InvalidParam
from .functions.analysis import Analyzer
from .operators import mutations, postings, ranking
from .operators.graph_index import GraphIndex
from .plans import parser
from .plans.compiler import Compiler, IndexedCompiler
from .plans.ir import Node, Search
from .sources.records import infer_schema, invalid_json, invalid_vectors, shred
from .sources.storage import Storage
from .types import Field, FieldType, Schema

RECORD = "_id bigint, _name string, _data string"
#: When roll() compacts: more segments than this, or the oldest one older than this many seconds.
MAX_SEGMENTS, MAX_AGE = 64, 3600.0
ACTION = "_seq bigint, _action string, _name string, _data string"


class Collection:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.storage = spark, Storage(spark, path)
        self.schema = self.storage.schema()

    # Reading

    def raw(self) -> DataFrame:
        """(_id, _name, _data) of the live records, as of now."""
        m = self.storage.manifest()
        return self._live(self.storage.read_segments(m["segments"], RECORD), m)

    def _live(self, rows: DataFrame, m: dict) -> DataFrame:
        gone = self._gone(m)
        return rows if gone is None else rows.join(gone, "_id", "left_anti")

    def _gone(self, m: dict) -> DataFrame | None:
        return self.storage.read_segments(m["tombstones"], "_id bigint") if m["tombstones"] else None

    def scan(self) -> DataFrame:
        """Live records with a column for each indexed field; Catalyst drops the ones that a query does not use."""
        rows = self.raw()
        schema = infer_schema(rows, self.schema.name) if self.schema.schemaless and not self.schema.fields else self.schema
        return shred(rows, schema)

    def get(self, name: str) -> DataFrame:
        """The latest live record of a name."""
        return self.raw().filter((F.col("_name") == name) & F.lit(name != "")).orderBy(F.desc("_id")).limit(1)

    def find_by_id(self, record_id: int) -> DataFrame:
        return self.raw().filter(F.col("_id") == record_id)

    def ids_of(self, names: DataFrame) -> DataFrame:
        """(_name, _id): the latest live record of each of a table of names."""
        wanted = names.select("_name").filter("_name <> ''").distinct()
        return self.raw().join(wanted, "_name").groupBy("_name").agg(F.max("_id").alias("_id"))

    def analyzers(self) -> dict[str, Analyzer]:
        return {f.name: Analyzer(f.text) for f in self.schema.fields.values() if f.type is FieldType.TEXT}

    def compiler(self) -> Compiler:
        """Over the records' columns; indexed fields are answered from their postings and graphs."""
        m = self.storage.manifest()
        texts = {f.name: self._postings(f, m) for f in self.schema.fields.values() if f.type is FieldType.TEXT and f.name in m["indexed"]}
        graphs = {f.name: f.name for f in self.schema.fields.values() if f.type is FieldType.VECTOR and not f.array and f.name in m["indexed"]}
        if not texts and not graphs:
            return Compiler(self.scan(), "_id", self.analyzers())
        return IndexedCompiler(self.scan(), self.analyzers(), texts, {f: lambda q, k, allowed, f=f: self._near(f, m, q, k, allowed) for f in graphs})

    # Indexes: one for each segment, written with it

    def build_index(self, field: str) -> None:
        """Index a text or vector field from now on: all segments now, later ones as they are written."""
        own = self.schema.fields.get(field)
        if own is None or own.type not in (FieldType.TEXT, FieldType.VECTOR):
            raise InvalidParam(f"{field!r} is no text or vector field")
        m = self.storage.manifest()
        if field not in m["indexed"]:
            m = {**m, "version": m["version"] + 1, "indexed": [*m["indexed"], field]}
            for segment in m["segments"]:
                m = self._indexed(m, segment, [field])
            self.storage.put_manifest(m)

    def _indexed(self, m: dict, segment: str, fields: list[str]) -> dict:
        """The manifest with a segment's indexes, which are written here."""
        rows = shred(self.storage.read_segments([segment], RECORD), self.schema)
        for name in fields:
            own, kind = self.schema.fields[name], "postings" if self.schema.fields[name].type is FieldType.TEXT else "graphs"
            path = self.storage.new_name(kind)
            if kind == "postings":
                postings.write(rows, name, f"{self.storage.path}/{path}", Analyzer(own.text))
            elif own.vector.metric == "euclidean" and not own.array:
                GraphIndex.build(rows, "_id", name, path=f"{self.storage.path}/{path}")
            else:
                continue  # other metrics, and several vectors in a record, are ranked exactly
            m = {**m, kind: {**m[kind], f"{segment}|{name}": path}}
        return m

    def _postings(self, f: Field, m: dict) -> postings.PostingsIndex | None:
        paths = [f"{self.storage.path}/{p}" for key, p in m["postings"].items() if key.partition("|")[2] == f.name]
        return postings.PostingsIndex.open(self.spark, paths, Analyzer(f.text), self._gone(m)) if paths else None

    def vocabulary(self, field: str) -> DataFrame:
        """(token, df) of a text field: from its postings, or from the texts where it is not indexed."""
        own, m = self.schema.fields.get(field), self.storage.manifest()
        if own is None or own.type is not FieldType.TEXT:
            raise InvalidParam(f"{field!r} is no text field")
        index = self._postings(own, m) if field in m["indexed"] else None
        if index is not None:
            return index.vocabulary()
        tokens = self.scan().select(F.explode(F.array_distinct(Analyzer(own.text).tokens(F.col(f"`{field}`")))).alias("token"))
        return postings.document_frequencies(tokens)

    def suggest(self, field: str, prefix: str, n: int = 10) -> DataFrame:
        """The most frequent n tokens of a field that begin with a prefix."""
        return ranking.suggest(self.vocabulary(field), prefix, n)

    def near_terms(self, field: str, word: str, distance: int = 1) -> DataFrame:
        """(token, df) of a field within an edit distance of a word."""
        return ranking.near_terms(self.vocabulary(field), word, distance)

    def _near(self, field: str, m: dict, query: list[float], k: int, allowed: DataFrame | None) -> DataFrame | None:
        """(_id) of what the graphs of all segments find; None where there is no graph of the field."""
        found, asked = None, self.spark.createDataFrame([(0, query)], "query_id bigint, vector array<double>")
        for key, path in m["graphs"].items():
            if key.partition("|")[2] == field:
                own = GraphIndex.load(self.spark, f"{self.storage.path}/{path}").search(asked, k, max(200, 2 * k), allowed, self._gone(m)).select("_id")
                found = own if found is None else found.unionByName(own)
        return found

    # Searching

    def sql(self, text: str) -> DataFrame:
        """The page of a query in the dialect."""
        return self.compiler().search(parser.parse(text))

    def search(self, query: str | Node | None = None, fields: Iterable[str] = (), order_by: Iterable[str] = (), offset: int = 0, limit: int = 10) -> DataFrame:
        """The same with the parts of a query apart; order_by items are "field asc" or "field desc"."""
        return self.compiler().search(self._search(query, fields, order_by, offset, limit))

    def _search(self, query, fields, order_by, offset, limit) -> Search:
        where = parser.parse_where(query) if isinstance(query, str) else query
        return Search(where, tuple((f, f) for f in fields), parser.parse_order(list(order_by)), offset, limit)

    def sorted_hits(self, query: str | Node | None = None, order_by: Iterable[str] = (), limit: int = 10) -> DataFrame:
        """Hits with _sort, the values that they are ordered by, and _id, so that pages of several collections can be merged outside."""
        s = self._search(query, (), order_by, 0, limit)
        hits, keys = self.compiler().search(s), [n for n, _ in s.order]
        return hits.withColumn("_sort", F.array(*[F.col(f"`{n}`").cast("string") for n in keys], F.col("_id").cast("string")))

    def total_hits(self, query: str | Node | None = None) -> int:
        where = parser.parse_where(query) if isinstance(query, str) else query
        return self.compiler().total_hits(where).first()[0]

    def hits_json(self, hits: DataFrame) -> DataFrame:
        """(_id, json): hits as JSON objects."""
        return hits.select("_id", F.to_json(F.struct(*[F.col(f"`{c}`") for c in hits.columns])).alias("json"))

    # Changing

    def actions(self, rows: Iterable[tuple[str, str, str | dict]]) -> DataFrame:
        """A batch from (action, name, JSON or dict) tuples."""
        return self.spark.createDataFrame([(k, a, n, d if isinstance(d, str) else json.dumps(d)) for k, (a, n, d) in enumerate(rows)], ACTION)

    def mutate(self, batch: DataFrame, marker: str | None = None, stream: str = "") -> DataFrame:
        """Apply a batch (_seq, _action, _name, _data); returns (_seq, _name, _action, code), 0 for what was done.

        The batch is applied whole: it becomes visible when its manifest is written, with the
        stream's marker, which a caller can read back to know how far it had come. Where another
        writer was faster a StorageError is raised, and nothing has changed.
        """
        m = self.storage.manifest()
        batch = batch.select("_seq", "_action", F.coalesce("_name", F.lit("")).alias("_name"), "_data")
        unknown = ~F.col("_action").isin(mutations.APPEND, mutations.INSERT, mutations.UPSERT, mutations.DELETE)
        bad = ((invalid_json() | invalid_vectors(self.schema)) & (F.col("_action") != mutations.DELETE)) | unknown
        base = self._live(self.storage.read_segments(m["segments"], RECORD), m)
        applied = mutations.apply_batch(base, batch.withColumn("_invalid", bad), m["next_id"])
        added = self.storage.write_segment(applied.added.select("_id", "_name", "_data"), "records")
        hidden = self.storage.write_segment(applied.hidden.select("_id"), "tombstones")
        results = mutations.written(applied.results, "results")
        written = results.filter((F.col("code") == 0) & (F.col("_action") != mutations.DELETE)).count()
        markers = m["markers"] if marker is None else {**m["markers"], stream: marker}
        after = {**m, "version": m["version"] + 1, "next_id": m["next_id"] + written, "segments": [*m["segments"], added], "tombstones": [*m["tombstones"], hidden], "markers": markers}
        self.storage.put_manifest(self._indexed(after, added, m["indexed"]))
        return results.orderBy("_seq")

    def mutate_json(self, action: str, name: str, data: str | dict, marker: str | None = None) -> int:
        """One action; returns its code."""
        return self.mutate(self.actions([(action, name, data)]), marker).first()["code"]

    def marker(self, stream: str = "") -> str | None:
        return self.storage.manifest()["markers"].get(stream)

    def persist(self, max_records_per_file: int = 1_000_000) -> None:
        """Compact: the live records in one new segment, no tombstones. Rows stay in the order of ids; indexes are made anew."""
        m = self.storage.manifest()
        live = self._live(self.storage.read_segments(m["segments"], RECORD), m).repartitionByRange("_id").sortWithinPartitions("_id")
        name = self.storage.write_segment(live.select("_id", "_name", "_data"), "records", max_records_per_file)
        after = {**m, "version": m["version"] + 1, "segments": [name], "tombstones": [], "postings": {}, "graphs": {}}
        self.storage.put_manifest(self._indexed(after, name, m["indexed"]))

    def roll(self, max_segments: int = MAX_SEGMENTS, max_age: float = MAX_AGE) -> bool:
        """Compact if there are more than max_segments segments, or something to compact for more than max_age seconds; True if so.

        To be called now and then, by a scheduler or after each batch of a stream; what it replaces
        is freed by Storage.sweep().
        """
        m = self.storage.manifest()
        loose = len(m["segments"]) > 1 or bool(m["tombstones"])
        old = loose and self.storage.files.age(f"{self.storage.path}/{m['segments'][0]}") > max_age
        if len(m["segments"]) > max_segments or old:
            self.persist()
            return True
        return False

    def add_field(self, field: Field) -> None:
        """Index a field from now on; it is read from the JSON of all records, old ones too."""
        self.schema = self.schema.with_field(field)
        self.storage.put_schema(self.schema)

    def drop_field(self, name: str) -> None:
        self.schema = self.schema.without_field(name)
        self.storage.put_schema(self.schema)

    def info(self) -> DataFrame:
        """(segment, n, n_deleted, first_id, last_id, bytes) of what is stored."""
        m, rows = self.storage.manifest(), None
        for name in m["segments"]:
            own = self.storage.read_segments([name], RECORD).select(F.lit(name).alias("segment"), "_id")
            rows = own if rows is None else rows.unionByName(own)
        if rows is None:
            rows = self.spark.createDataFrame([], "segment string, _id bigint")
        return self.storage.info(rows, m["tombstones"])

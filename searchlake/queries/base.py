"""How queries are registered, and the collections that they search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.analysis import Analyzer
from ..plans import parser
from ..plans.compiler import Compiler

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def query(sql: str | None = None, name: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with the SQL of its rows."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


def _words(df: DataFrame) -> DataFrame:
    return df.withColumn("words", F.split("p_name", " "))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(read(spark, sf_dir, "labels"), "doc_id", "left").withColumn("good", F.col("quality") == 1)


def collection(spark: SparkSession, sf_dir: str, table: str) -> Compiler:
    """A driver table as a searchable collection; labelled is documents with labels, missing for most."""
    if table == "labelled":
        return Compiler(_labelled(spark, sf_dir), "doc_id")
    df = read(spark, sf_dir, table)
    if table == "part":
        return Compiler(_words(df), "p_partkey")
    keys = {"orders": "o_orderkey", "customer": "c_custkey", "documents": "doc_id", "pages": "page_id", "conversations": "conv_id", "events": "event_id", "embeddings": "vec_id", "supplier": "s_suppkey"}
    text = {"documents": {"text": Analyzer()}, "pages": {"html": Analyzer()}, "conversations": {"text": Analyzer()}}
    return Compiler(df, keys[table], text.get(table))


def matching(name: str, table: str, where: str, columns: str, sql: str) -> None:
    """Register all records that a predicate of the dialect matches; sql: their WHERE clause in SQL, or a whole SELECT."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = collection(spark, sf_dir, table)
        return c.matches(parser.parse_where(where)).select(*columns.split(", "))

    run.__doc__ = f"{table} WHERE {where}"
    query(sql if sql.lstrip().upper().startswith(("SELECT", "WITH")) else f"SELECT {columns} FROM {SOURCES.get(table, table)} WHERE {sql}", name)(run)


SOURCES = {
    "part": "(SELECT *, string_split(p_name, ' ') AS words FROM part)",
    "labelled": "(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic, l.quality = 1 AS good FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)",
}


def dialect(name: str, table: str, text: str, columns: str, sql: str) -> None:
    """Register the page that a whole query of the dialect gives."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return collection(spark, sf_dir, table).search(parser.parse(text)).select(*columns.split(", "))

    run.__doc__ = text
    query(sql, name)(run)

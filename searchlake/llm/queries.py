"""One query for each training-data operator, over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, htmltext, kdshard, linededup, neardup, packing, quality, secrets, toxicity, vafile
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


@query(linededup.ORACLE)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the later occurrences of repeated lines."""
    return linededup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


@query(decontaminate.ORACLE)
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a run of eight words with a benchmark item, by item, with place and extent."""
    return decontaminate.find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query()
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window and offset of every document's tokens."""
    return packing.pack(read(spark, sf_dir, "documents"))


@query()
def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups as lists of document ids."""
    return neardup.group_lists(neardup.near_groups(read(spark, sf_dir, "documents")))


@query()
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier keeps, with their scores."""
    return quality.score(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "quality")


@query()
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier flags as toxic, with their scores."""
    return toxicity.find_toxic(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query()
def op1_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    return kdshard.shard(read(spark, sf_dir, "documents"))


@query(vafile.ORACLE)
def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest others, among all embeddings, of every one whose id is divisible by 50, exactly."""
    return vafile.nearest(read(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 50 == 0)


@query()
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, along the path that its host's pages agree on."""
    return htmltext.extract(read(spark, sf_dir, "pages"))


@query(secrets.ORACLE)
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of characters in documents that looks like a key."""
    return secrets.find_secrets(read(spark, sf_dir, "documents"))

"""A corpus pipeline of five stages, each of which reads what the one before it wrote.

All but the last return the columns of their input, other columns of whatever name included. Empty
tables go through as empty tables. Rows that repeat are alike to every stage but near_dedup, which
keeps one of them; rows without an id take part in all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchlake.llm import decontaminate, linededup, neardup, packing, quality
from searchlake.llm.common import Scratch, fresh, quoted, read


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier, fitted on this stage's input, does not reject; null, empty and wordless texts are rejected."""
    given = docs
    if "quality" in docs.columns:
        (aside,) = fresh(docs.columns, "quality")
        docs = docs.withColumnRenamed("quality", aside)
    return quality.score(docs).drop("quality").toDF(*given.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of repeated lines; one of which nothing but blanks is left goes. n_chars follows the text."""
    given = docs
    if "n_removed" in docs.columns:  # the operator's own column; the input's comes back under its name
        (aside,) = fresh(docs.columns, "n_removed")
        docs = docs.withColumnRenamed("n_removed", aside)
    out = linededup.dedup_lines(docs)
    out = out.filter((F.col("n_removed") == 0) | (F.trim(F.translate("text", "\n\r\t", "   ")) != ""))
    size = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", size).select(*quoted(docs.columns)).toDF(*given.columns)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, repeated rows and rows without an id included; texts without a word all stay."""
    return neardup.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the benchmark's passages; those that are mostly such passages go. Null and empty texts stay."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document's tokens in training windows; texts without a word take none."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_near),
    ("decontaminate", remove_benchmark),
    ("packing", pack_windows),
]

#: Neither the classifier nor MinHash nor packing can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next reads it."""
    scratch, docs = Scratch(spark, "pipeline"), read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

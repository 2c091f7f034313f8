"""Append, insert, upsert and delete as one plan over a batch.

Within a batch the actions on one name take effect in the order of _seq. After any action on a
name it is known whether the name exists, so the state that an action meets is that of the
action before it, or of the collection for the first: one window, no loop.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import CODES
from ..scratch import written

APPEND, INSERT, UPSERT, DELETE = "append", "insert", "upsert", "delete"


def number_rows(df: DataFrame, order: str, name: str, start: int = 0) -> DataFrame:
    """df with a column name of start + 1, start + 2, ... in the order of a column, without one partition for all rows."""
    placed = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__m", F.monotonically_increasing_id())
    placed = written(placed, "numbered")  # the numbers must not change between the two uses
    shard = F.shiftright("__m", 33)
    sizes = placed.groupBy(shard.alias("__p")).agg(F.count("*").alias("n"), F.min("__m").alias("first")).orderBy("__p").collect()
    rows, total = [], start
    for r in sizes:
        rows.append((r["__p"], total - r["first"] + 1))
        total += r["n"]
    if not rows:
        return placed.drop("__m").withColumn(name, F.lit(None).cast("bigint"))
    offsets = df.sparkSession.createDataFrame(rows, "__p bigint, __o bigint")  # a row for each partition
    return placed.withColumn("__p", shard).join(F.broadcast(offsets), "__p").withColumn(name, F.col("__m") + F.col("__o")).drop("__p", "__o", "__m")


@dataclass
class Applied:
    """What a batch does: results by action, new records, and the ids that it hides."""

    results: DataFrame
    added: DataFrame
    hidden: DataFrame


def _alone():
    """Apart for each unnamed action, which no other can affect: else all of them would be in one partition of a window."""
    return F.when(F.col("_name") == "", F.col("_seq"))


def decide(names: DataFrame, batch: DataFrame) -> DataFrame:
    """batch with a code for each action. names: the collection's live _name values. An empty name matches nothing."""
    known = names.select(F.col("_name").alias("__known")).filter("__known <> ''").distinct()
    bad = F.col("_invalid") if "_invalid" in batch.columns else F.lit(False)
    state = F.when(bad, None).otherwise(F.col("_action") != DELETE)
    before = Window.partitionBy("_name", _alone()).orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = batch.join(known, F.col("_name") == F.col("__known"), "left")
    seen = seen.withColumn("__exists", F.when(F.col("_name") == "", False).otherwise(F.coalesce(F.last(state, ignorenulls=True).over(before), F.col("__known").isNotNull())))
    code = F.when(bad, CODES["InvalidParam"])
    code = code.when((F.col("_action") == INSERT) & F.col("__exists"), CODES["Duplicated"])
    code = code.when((F.col("_action") == DELETE) & ~F.col("__exists"), CODES["NotExisted"]).otherwise(0)
    return seen.withColumn("code", code).drop("__known", "__exists")


def apply_batch(base: DataFrame, batch: DataFrame, next_id: int | None = None) -> Applied:
    """Apply a batch (_seq, _action, _name, columns) to live records (_id, _name, columns).

    An upsert or delete hides every earlier live record of its name, also ones of the same
    batch. Ids go up from next_id, or from the largest in base, in the order of _seq, one for each
    action that writes, whether or not a later one hides it again.
    """
    if next_id is None:
        next_id = (base.agg(F.max("_id")).first()[0] or 0) + 1
    coded = decide(base.select("_name"), batch)
    replaces = (F.col("code") == 0) & F.col("_action").isin(UPSERT, DELETE) & (F.col("_name") != "")
    after = Window.partitionBy("_name", _alone()).orderBy("_seq").rowsBetween(1, Window.unboundedFollowing)
    coded = coded.withColumn("__replaced", F.coalesce(F.max(replaces).over(after), F.lit(False)))
    writes = coded.filter((F.col("code") == 0) & (F.col("_action") != DELETE))
    numbered = number_rows(writes, "_seq", "_id", next_id - 1)
    extra = [c for c in batch.columns if c not in ("_seq", "_action", "_name", "_invalid", "_id")]
    added = numbered.filter(~F.col("__replaced")).select("_id", "_name", *extra)
    gone = coded.filter(replaces).select("_name").distinct()
    hidden = base.join(gone, "_name", "left_semi").select("_id")
    return Applied(coded.select("_seq", "_name", "_action", "code"), added, hidden)


def merged(base: DataFrame, applied: Applied) -> DataFrame:
    """The live records after a batch."""
    return base.join(applied.hidden, "_id", "left_anti").unionByName(applied.added, allowMissingColumns=True)


def upsert_latest(base: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """A plain bulk upsert: of each key the row of the highest order, changes before base."""
    both = base.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc("__new"), F.desc(order))
    return both.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r", "__new")

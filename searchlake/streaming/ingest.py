"""A stream of actions applied to a collection, each micro-batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..collection import Collection


def ingest(stream: DataFrame, collection: Collection, checkpoint: str, name: str = "ingest", **trigger) -> StreamingQuery:
    """Apply a stream (_seq, _action, _name, _data) as it comes.

    The number of the last batch is the collection's marker of this stream's name, written with the
    batch's manifest: a batch that is replayed after a failure is seen to be done, and is skipped,
    whatever other streams or callers did in between. Streams into one collection need names of their own.
    """

    def apply(batch: DataFrame, number: int) -> None:
        last = collection.marker(name)
        if last is None or number > int(last):
            collection.mutate(batch, str(number), name)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).queryName(name).trigger(**(trigger or {"availableNow": True})).start()


def upserts(stream: DataFrame, name: str, sequence: str) -> DataFrame:
    """A stream of rows as upserts: a name column, an order column, and all columns as JSON."""
    data = F.to_json(F.struct(*[F.col(c) for c in stream.columns]))
    return stream.select(F.col(sequence).cast("bigint").alias("_seq"), F.lit("upsert").alias("_action"), F.col(name).cast("string").alias("_name"), data.alias("_data"))

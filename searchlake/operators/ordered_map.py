"""An ordered map as a table of keys and values, with expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class OrderedMap:
    """Immutable: every change gives a new map over a new plan, so any map is a snapshot."""

    def __init__(self, df: DataFrame, key: str, expiry: str | None = None):
        self.df, self.key, self.expiry = df, key, expiry

    def _new(self, df: DataFrame) -> OrderedMap:
        return OrderedMap(df, self.key, self.expiry)

    def get(self, key) -> DataFrame:
        return self.df.filter(F.col(self.key) == F.lit(key))

    def __len__(self) -> int:
        return self.df.count()

    def is_empty(self) -> bool:
        return not self.df.head(1)

    def merge(self, batch: DataFrame, deleted: str) -> OrderedMap:
        """Put and delete many keys at once: batch has the map's columns and a boolean column deleted."""
        old, new = self.df.alias("o"), batch.alias("n")
        joined = old.join(new, F.col(f"o.{self.key}") == F.col(f"n.{self.key}"), "full_outer").filter(~F.coalesce(F.col(f"n.{deleted}"), F.lit(False)))
        there = F.col(f"n.{self.key}").isNotNull()
        return self._new(joined.select(*[F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in self.df.columns]))

    def put(self, batch: DataFrame) -> OrderedMap:
        return self.merge(batch.withColumn("__deleted", F.lit(False)), "__deleted")

    def remove(self, keys: DataFrame) -> OrderedMap:
        return self._new(self.df.join(keys.select(self.key), self.key, "left_anti"))

    def scan(self, descending: bool = False) -> DataFrame:
        return self.df.orderBy(F.col(self.key).desc() if descending else F.col(self.key).asc())

    def seek(self, key, n: int = 1) -> DataFrame:
        """The first n entries at or after a key."""
        return self.df.filter(F.col(self.key) >= F.lit(key)).orderBy(F.col(self.key).asc()).limit(n)

    def seek_prev(self, key, n: int = 1) -> DataFrame:
        """The last n entries at or before a key, the last first."""
        return self.df.filter(F.col(self.key) <= F.lit(key)).orderBy(F.col(self.key).desc()).limit(n)

    def split_off(self, key) -> tuple[OrderedMap, OrderedMap]:
        """The entries before a key, and those from it on."""
        return self._new(self.df.filter(F.col(self.key) < F.lit(key))), self._new(self.df.filter(F.col(self.key) >= F.lit(key)))

    def ends(self) -> DataFrame:
        """One row: all columns of the smallest entry as min_*, of the largest as max_*."""
        others = [c for c in self.df.columns if c != self.key]
        return self.df.agg(
            F.min(self.key).alias(f"min_{self.key}"), F.max(self.key).alias(f"max_{self.key}"),
            *[F.min_by(c, self.key).alias(f"min_{c}") for c in others], *[F.max_by(c, self.key).alias(f"max_{c}") for c in others],
        )

    def expire(self, now: Column) -> OrderedMap:
        """The map without entries whose expiry is before now; until then reads still see them."""
        return self._new(self.df.filter(F.col(self.expiry).isNull() | (F.col(self.expiry) >= now)))

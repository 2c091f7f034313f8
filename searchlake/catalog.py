"""The collections under one folder."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .collection import Collection
from .errors import Existed, InvalidParam, NotExisted
from .sources.storage import Files, Storage
from .types import Schema


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.open = spark, root.rstrip("/"), {}

    def _path(self, name: str) -> str:
        if not name or "/" in name or name.startswith((".", "_")):
            raise InvalidParam(f"collection name {name!r}")
        return f"{self.root}/{name}"

    def create(self, schema: Schema) -> Collection:
        """A new, empty collection."""
        path = self._path(schema.name)
        if Files(self.spark).exists(f"{path}/schema.json"):
            raise Existed(f"collection {schema.name}")
        Storage(self.spark, path).create(schema)
        return self.load(schema.name)

    def load(self, name: str) -> Collection:
        """Open a collection. Nothing is deleted: what broken writes left is in no manifest, and Storage.sweep() frees it."""
        path = self._path(name)
        if not Files(self.spark).exists(f"{path}/schema.json"):
            raise NotExisted(f"collection {name}")
        c = Collection(self.spark, path)
        self.open[name] = c
        return c

    def get(self, name: str) -> Collection:
        if name not in self.open:
            raise NotExisted(f"collection {name} is not loaded")
        return self.open[name]

    def release(self, name: str) -> None:
        """Forget an open collection and its view; its files stay."""
        self.get(name)
        self.spark.catalog.dropTempView(name)
        del self.open[name]

    def list(self) -> list[str]:
        files = Files(self.spark)
        return [n for n in files.children(self.root) if files.exists(f"{self.root}/{n}/schema.json")]

    def view(self, name: str) -> None:
        """Make a collection a temporary view, for all of Spark SQL."""
        self.get(name).scan().createOrReplaceTempView(name)

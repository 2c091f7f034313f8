"""Collections on disk: segments of Parquet under a manifest that is swapped whole.

A mutation writes new segments and tombstones, then a new manifest; readers see either the old
one or the new one, and of two writers of one version only one succeeds. What a broken write
leaves behind is in no manifest; sweep() deletes it once it is old.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Existed, NotExisted, StorageError
from ..types import Schema

EMPTY = {"version": 0, "next_id": 1, "segments": [], "tombstones": [], "marker": None, "markers": {}, "indexed": [], "postings": {}, "graphs": {}}
KINDS = ("records", "tombstones", "postings", "graphs")
#: Seconds for which nothing may have changed a segment before it can be swept, and manifests that are kept.
GRACE, KEEP = 24 * 3600.0, 10
#: Seconds after which a version that was begun but not written is given up.
LOCK = 600.0


class Files:
    """Small files and folders on whatever file system Hadoop finds behind a path."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def children(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        source = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def write(self, path: str, text: str) -> None:
        """Write beside the path, then rename over it."""
        fs, p = self._at(path)
        tmp = self._beside(path, text)
        if fs.exists(p):
            fs.delete(p, False)
        if not fs.rename(tmp, p):
            raise StorageError(f"cannot write {path}")

    def write_new(self, path: str, text: str) -> bool:
        """Write a file that is not there yet, whole or not at all; False where another writer was faster.

        The commit point is a file that the file system creates only if it is absent; the writer
        that created it renames the text into its place.
        """
        fs, p = self._at(path)
        if fs.exists(p):
            return False
        lock = self.jvm.org.apache.hadoop.fs.Path(f"{path}.lock")
        try:
            fs.create(lock, False).close()
        except Py4JJavaError as e:
            if fs.exists(p):
                return False
            if fs.exists(lock):
                if self.age(f"{path}.lock") > LOCK:  # its writer is gone; the next attempt finds the way free
                    fs.delete(lock, False)
                return False
            raise StorageError(f"cannot write {path}: {e.java_exception}") from None
        if not fs.rename(self._beside(path, text), p):
            raise StorageError(f"cannot write {path}")
        return True

    def _beside(self, path: str, text: str):
        fs, _ = self._at(path)
        tmp = self.jvm.org.apache.hadoop.fs.Path(f"{path}-{uuid.uuid4().hex[:8]}-tmp")
        out = fs.create(tmp, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return tmp

    def age(self, path: str) -> float:
        """Seconds since anything directly in a folder, or the folder itself, was last changed."""
        fs, p = self._at(path)
        last = max([fs.getFileStatus(p).getModificationTime(), *(s.getModificationTime() for s in fs.listStatus(p))])
        return time.time() - last / 1000

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


class Storage:
    """One collection's folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path, Files(spark)

    def create(self, schema: Schema) -> None:
        if self.files.exists(f"{self.path}/schema.json"):
            raise Existed(f"collection at {self.path}")
        self.files.write(f"{self.path}/schema.json", schema.json())
        self.put_manifest(dict(EMPTY))

    def schema(self) -> Schema:
        if not self.files.exists(f"{self.path}/schema.json"):
            raise NotExisted(f"collection at {self.path}")
        own = f"{self.path}/user_schema.json"
        return Schema.from_json(self.files.read(own if self.files.exists(own) else f"{self.path}/schema.json"))

    def put_schema(self, schema: Schema) -> None:
        """The schema as changed after creation; the original stays beside it."""
        self.files.write(f"{self.path}/user_schema.json", schema.json())

    def manifest(self) -> dict:
        versions = [n for n in self.files.children(f"{self.path}/manifests") if n.endswith(".json")]
        if not versions:
            raise NotExisted(f"collection at {self.path}")
        return EMPTY | json.loads(self.files.read(f"{self.path}/manifests/{versions[-1]}"))

    def put_manifest(self, m: dict) -> None:
        """Make a version the current one; raises where another writer made that version first."""
        if not self.files.write_new(f"{self.path}/manifests/{m['version']:012d}.json", json.dumps(m)):
            raise StorageError(f"version {m['version']} is there: another writer was faster")

    def new_name(self, kind: str) -> str:
        return f"{kind}/{uuid.uuid4().hex}"

    def write_segment(self, df: DataFrame, kind: str, max_records_per_file: int = 0) -> str:
        name = self.new_name(kind)
        df.write.option("maxRecordsPerFile", max_records_per_file).parquet(f"{self.path}/{name}")
        return name

    def read_segments(self, names: list[str], schema) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names])

    def sweep(self, grace: float = GRACE, keep: int = KEEP) -> list[str]:
        """Delete the segments that none of the last keep manifests names, and older manifests; returns what went.

        Only what has not changed for grace seconds goes: a writer that is still at work has
        segments that no manifest names yet, and a reader may still hold a version just replaced.
        """
        versions = [v for v in self.files.children(f"{self.path}/manifests") if v.endswith(".json")]
        named, gone = set(), []
        for v in versions[-keep:]:
            m = json.loads(self.files.read(f"{self.path}/manifests/{v}"))
            named |= {*m["segments"], *m["tombstones"], *m.get("postings", {}).values(), *m.get("graphs", {}).values()}
        for kind in KINDS:
            for n in self.files.children(f"{self.path}/{kind}"):
                if f"{kind}/{n}" not in named and self.files.age(f"{self.path}/{kind}/{n}") >= grace:
                    gone.append(f"{kind}/{n}")
        if self.files.exists(f"{self.path}/manifests") and self.files.age(f"{self.path}/manifests") >= grace:
            gone += [f"manifests/{n}" for v in versions[:-keep] for n in (v, f"{v}.lock")]
        for g in gone:
            self.files.delete(f"{self.path}/{g}")
        return gone

    def info(self, rows: DataFrame, tombstones: list[str]) -> DataFrame:
        """(segment, n, n_deleted, first_id, last_id, bytes) of the stored records by the segment they are in; n counts live ones."""
        sizes = {n: self.files.size(f"{self.path}/{n}") for n in self.manifest()["segments"]}
        hidden = self.read_segments(tombstones, "_id bigint").distinct().select(F.col("_id").alias("__gone"))
        each = rows.join(hidden, F.col("_id") == F.col("__gone"), "left").groupBy("segment").agg(F.count("*").alias("all"), F.count("__gone").alias("n_deleted"), F.min("_id").alias("first_id"), F.max("_id").alias("last_id"))
        each = each.select("segment", (F.col("all") - F.col("n_deleted")).alias("n"), "n_deleted", "first_id", "last_id")
        known = self.spark.createDataFrame(list(sizes.items()), "segment string, bytes bigint")  # a row for each segment
        return known.join(each, "segment", "left").select("segment", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_deleted", F.lit(0)).alias("n_deleted"), "first_id", "last_id", "bytes")

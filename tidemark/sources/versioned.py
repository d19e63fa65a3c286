"""A keyed table in hash buckets with committed versions.

``folder/data/<commit>/tidemark_bucket=<b>`` holds rows, ``folder/versions/<n>`` is a small file that names the folder of every bucket, and a version
is there when its file is: it is written aside and renamed, which fails if somebody else was first. merge() reads and
writes only the buckets that a batch touches; files of others stay as they are. A version remembers the highest batch number
merged, so a batch that comes again after a failure changes nothing. Versions before the last ``keep`` and data that
no kept version names are removed after a commit; what a failed merge left behind goes then, too.

Everything goes through Spark and the Hadoop file system of the path, so the folder may be in any store they reach; the store
must rename atomically. One writer at a time is meant; a second one fails at its commit and writes nothing. Buckets' names on the driver are bounded by
their number; rows are written by bucket and share, so no task writes a large bucket alone.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.sinks import upsert

#: Marks that a batch takes a key's row out.
DELETED = "__deleted"


class VersionedTable:
    """One row per ``key``, the last by ``order``."""

    def __init__(self, spark: SparkSession, folder: str, key: list[str], order: str, buckets: int = 64, shares: int = 4, keep: int = 2) -> None:
        self.spark, self.folder, self.key, self.order = spark, folder.rstrip("/"), key, order
        self.buckets, self.shares, self.keep = buckets, shares, keep
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        place = self._path("versions")
        if not self._fs.exists(place):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(place)]
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """What a version (the last one) consists of: batch number, schema, and the data folder of every bucket that has rows."""
        if version is None:
            found = self.versions()
            if not found:
                return {"version": 0, "batch": -1, "schema": None, "buckets": {}}
            version = found[-1]
        stream = self._fs.open(self._path("versions", str(version)))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version; None before the first commit."""
        rows = self._stored(version)
        return None if rows is None else rows.where(f"NOT {DELETED}").drop(DELETED)

    def _stored(self, version: int | None = None, only: set[int] | None = None) -> DataFrame | None:
        held = self.manifest(version)
        if held["schema"] is None:
            return None
        schema = self.spark.createDataFrame([], held["schema"]).schema
        places = [f"{self.folder}/data/{place}/tidemark_bucket={b}" for b, place in sorted(held["buckets"].items()) if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def merge(self, batch: DataFrame, number: int) -> int:
        """Merge ``batch`` as number ``number``, which must grow; the version that holds it. Rows with a true column
        ``__deleted`` take their key out if they are the last, and stay as marks, so that older rows that come later don't bring it back."""
        held = self.manifest()
        if number <= held["batch"]:
            return held["version"]
        flag = F.coalesce(F.col(DELETED), F.lit(False)) if DELETED in batch.columns else F.lit(False)
        marked = batch.withColumn(DELETED, flag).persist()
        try:
            touched = {r.b for r in marked.select(self.bucket().alias("b")).distinct().collect()}  # ``buckets`` at most
            stored = self._stored(only=touched)
            schema = held["schema"] or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.schema)
            rows = upsert(marked.limit(0) if stored is None else stored, marked, self.key, self.order).select(*marked.columns)
            place = f"{held['version'] + 1}-{uuid.uuid4().hex[:12]}"
            share = F.pmod(F.xxhash64(F.lit("share"), *self.key), F.lit(self.shares))
            dealt = rows.withColumn("tidemark_bucket", self.bucket()).withColumn("__share", share).repartition("tidemark_bucket", "__share").drop("__share")
            dealt.write.partitionBy("tidemark_bucket").parquet(f"{self.folder}/data/{place}")
            written = self._fs.listStatus(self._path("data", place))
            full = {int(s.getPath().getName().split("=")[1]) for s in written if s.getPath().getName().startswith("tidemark_bucket=")}
        finally:
            marked.unpersist()
        buckets = {b: p for b, p in held["buckets"].items() if int(b) not in touched} | {str(b): place for b in full}
        return self._commit({"version": held["version"] + 1, "batch": number, "schema": schema, "buckets": buckets})

    def _commit(self, made: dict) -> int:
        """Write the version aside, then give it its name: the one step that counts."""
        aside, name = self._path("versions", f".{uuid.uuid4().hex}"), self._path("versions", str(made["version"]))
        self._fs.mkdirs(self._path("versions"))
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(made).encode()))
        out.close()
        if self._fs.exists(name) or not self._fs.rename(aside, name):
            self._fs.delete(aside, False)
            raise RuntimeError(f"version {made['version']} of {self.folder} was committed by another writer")
        self._clean()
        return made["version"]

    def _clean(self) -> None:
        found = self.versions()
        for version in found[: -self.keep]:
            self._fs.delete(self._path("versions", str(version)), False)
        used = {p for v in found[-self.keep :] for p in self.manifest(v)["buckets"].values()}
        for status in self._fs.listStatus(self._path("data")):
            if status.getPath().getName() not in used:
                self._fs.delete(status.getPath(), True)

    def sink(self):
        """For ``writeStream.foreachBatch``."""
        return lambda batch, number: self.merge(batch, number) and None

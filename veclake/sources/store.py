"""Durable collections: versioned Parquet snapshots and an append-only change log.

``<path>/versions/<version>`` has ``records/``, perhaps ``graph/``, and
``header.json``; ``<path>/published/<version>`` is an empty file, and the
largest name there counts.  ``<path>/log/b-<last seq>-...`` is one batch of
changes.  A batch or a version appears by one rename or create, whole or not
at all, and nothing that counts is removed before its successor counts.
Files go through Spark's and Hadoop's file systems, so any store will do.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changes import recover
from ..schema import changelog, records

FORMAT = 2
#: Settings that a stored collection must share with the one that opens it.
PINNED = ("metric", "quantization", "index_type")


class StoreError(RuntimeError):
    """A stored collection cannot be used as asked."""


class Store:
    def __init__(self, spark: SparkSession, path: str, id_type=None, meta_type=None):
        self.spark, self.path = spark, path.rstrip("/")
        self.log_schema, self.record_schema = changelog(id_type, meta_type), records(id_type, meta_type)
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # ------------------------------------------------------------ file system

    def _at(self, name: str):
        return self._path(f"{self.path}/{name}")

    def _names(self, folder: str) -> list[str]:
        """Names in a folder, in order; those being written start with a dot."""
        if not self.fs.exists(self._at(folder)):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self.fs.listStatus(self._at(folder))) if not n.startswith("."))

    def _drop(self, name: str) -> None:
        self.fs.delete(self._at(name), True)

    def _write(self, name: str, text: str) -> None:
        stream = self.fs.create(self._at(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def _rename(self, old: str, new: str) -> None:
        self.fs.mkdirs(self._at(new).getParent())
        if not self.fs.rename(self._at(old), self._at(new)):
            raise StoreError(f"cannot publish {new}")

    # ------------------------------------------------------------------- log

    def append(self, entries: DataFrame, last: int | None = None) -> None:
        """One batch of (seq, action, id, vector, sparse, meta): all of it or nothing, by a rename."""
        beside = f"log/.b-{uuid.uuid4().hex}"
        entries.select(self.log_schema.names).write.parquet(f"{self.path}/{beside}")
        if last is None:
            last = self.spark.read.schema(self.log_schema).parquet(f"{self.path}/{beside}").agg(F.max("seq")).first()[0]
        if last is None:
            self._drop(beside)
        else:
            self._rename(beside, f"log/b-{last:019d}-{uuid.uuid4().hex[:8]}")

    def _batches(self, after: int) -> list[str]:
        return [n for n in self._names("log") if int(n.split("-")[1]) > after]

    def log(self, after: int = -1) -> DataFrame:
        """Entries after a sequence number; older batches are not read.  A damaged file is an error, not skipped."""
        batches = self._batches(after)
        if not batches:
            return self.spark.createDataFrame([], self.log_schema)
        paths = [f"{self.path}/log/{n}" for n in batches]
        return self.spark.read.schema(self.log_schema).option("ignoreCorruptFiles", "false").parquet(*paths).where(F.col("seq") > after)

    def last_seq(self) -> int:
        """The largest sequence number, by the names of the batches."""
        return max([self.header().get("seq", -1), *(int(n.split("-")[1]) for n in self._names("log"))])

    def truncate(self, seq: int) -> None:
        """Drop the batches that end at ``seq`` or before; one that goes on stays whole."""
        for name in self._names("log"):
            if int(name.split("-")[1]) <= seq:
                self._drop(f"log/{name}")

    # -------------------------------------------------------------- versions

    def current(self) -> str | None:
        names = self._names("published")
        return names[-1] if names else None

    def header(self) -> dict:
        version = self.current()
        if version is None:
            return {}
        stream = self.fs.open(self._at(f"versions/{version}/header.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def save(self, live: DataFrame, header: dict, seq: int, graph: DataFrame | None = None) -> str:
        """Publish ``live`` (and its graph) as a new version; then the older ones and the log up to ``seq`` go."""
        old = self._names("published")
        number = 1 + (int(old[-1].split("-")[1]) if old else 0)
        version = f"v-{number:012d}-{uuid.uuid4().hex[:8]}"
        live.select(self.record_schema.names).write.mode("errorifexists").parquet(f"{self.path}/versions/{version}/records")
        if graph is not None:
            graph.write.mode("errorifexists").parquet(f"{self.path}/versions/{version}/graph")
        self._write(f"versions/{version}/header.json", json.dumps({"format": FORMAT, "seq": seq, "graph": graph is not None, **header}, sort_keys=True))
        self._write(f".published-{version}", "")
        self._rename(f".published-{version}", f"published/{version}")
        for name in old:
            self._drop(f"published/{name}")
            self._drop(f"versions/{name}")
        self.truncate(seq)
        return version

    def check(self, header: dict) -> dict:
        """The stored header, or StoreError where it contradicts ``header``."""
        stored = self.header()
        if not stored:
            return {}
        if stored.get("format") != FORMAT:
            raise StoreError(f"snapshot format {stored.get('format')}, expected {FORMAT}")
        for name in PINNED:
            if name in header and stored.get(name) != header[name]:
                raise StoreError(f"snapshot has {name} {stored.get(name)!r}, configured {header[name]!r}")
        want, have = header.get("dimensions", 0), stored.get("dimensions", 0)
        if want and have and want != have:
            raise StoreError(f"snapshot has {have} dimensions, configured {want}")
        return stored

    def recover(self, header: dict | None = None) -> DataFrame:
        """Live records: the published version and the log after it.  Either unreadable is an error."""
        stored = self.check(header or {})
        log = self.log(stored.get("seq", -1))
        if not stored:
            base = self.spark.createDataFrame([], self.record_schema)
        else:
            base = self.spark.read.schema(self.record_schema).parquet(f"{self.path}/versions/{self.current()}/records")
        return recover(base.withColumn("seq", F.lit(stored.get("seq", -1)).cast("long")), log).select(self.record_schema.names)

    def graph(self) -> DataFrame | None:
        """The graph of the published version, which lacks what the log has."""
        return self.spark.read.parquet(f"{self.path}/versions/{self.current()}/graph") if self.header().get("graph") else None

    def reset(self, header: dict) -> None:
        """A durable empty version first; then the log goes."""
        self.save(self.spark.createDataFrame([], self.record_schema), header, self.last_seq())

    # ----------------------------------------------------------------- beside

    def beside(self, name: str, rows: DataFrame) -> DataFrame:
        """``rows`` written to a table of their own below the collection, and read back."""
        path = f"{self.path}/{name}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        out = self.spark.read.schema(rows.schema).parquet(path)
        out._folder = path[len(self.path) + 1 :]
        return out

    def forget(self, rows: DataFrame | None) -> None:
        """Remove a table that ``beside`` wrote."""
        if rows is not None:
            self._drop(rows._folder)

"""A collection of vector records with the engine's verbs, over a Store."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable
from dataclasses import replace
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .config import EngineConfig
from .functions import filters
from .functions import vectors as V
from .operators import ann, changes, search, sparse, validate
from .sources.store import Store

#: What ``call`` may do.
VERBS = ("insert", "insert_many", "delete", "get", "count", "info", "search", "search_batch", "flush", "reset")
#: Rows of a batch of inserts.
ROW = "place long, id string, vector array<float>, sparse struct<indices:array<bigint>,values:array<float>>, meta string"


class Collection:
    """One writer; readers see the last committed batch.

    Vectors are stored encoded (int8 with scalar quantization).  Every change
    is appended to the log before it counts; ``flush`` publishes a snapshot,
    and so does the first change ``auto_save_seconds`` after the last one.

    With ``index_type`` hnsw all searches walk the graphs of ``operators.ann``:
    they are built once, kept in the snapshot, and changed record by record.
    A filter goes into the walk, or, without ``metadata_index``, all matches
    are scanned.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, config: EngineConfig | None = None):
        self.spark, self.config = spark, (config or EngineConfig()).checked()
        path = path or self.config.storage_path
        if not path:
            raise ValueError("a collection needs a path, or storage_path in its settings")
        kind = T.ByteType() if self.config.quantization == "scalar" else T.FloatType()
        self.store = Store(spark, path)
        for s in (self.store.log_schema, self.store.record_schema):
            s["vector"].dataType.elementType = kind
        stored = self.store.check(self._header())
        self.width = self.config.dimensions or stored.get("dimensions", 0)
        self.seq = self.store.last_seq()
        if not self.width and self.seq > stored.get("seq", -1):
            first = self.store.log().where("action = 'INSERT'").agg(F.min_by(F.size("vector"), "seq")).first()[0]
            self.width = first or 0
        self.index: DataFrame | None = None
        self.saved = time.monotonic()

    def _header(self) -> dict:
        c = self.config
        return {"metric": c.metric, "quantization": c.quantization, "index_type": c.index_type, "dimensions": getattr(self, "width", c.dimensions)}

    def records(self) -> DataFrame:
        """Live records, vectors as stored."""
        return self.store.recover(self._header())

    # ---------------------------------------------------------------- writing

    def insert(self, id: str, vector: list[float], sparse: tuple[list[int], list[float]] | None = None, meta: dict | None = None) -> None:
        """Insert or replace one record; InvalidVectorError if it cannot be stored."""
        failures = self.insert_many([(id, vector, sparse, meta)])["failures"].collect()
        if failures:
            raise validate.InvalidVectorError(failures[0]["error"])

    def insert_many(self, items: Iterable[tuple]) -> dict:
        """(id, vector, sparse, meta) items in chunks of ``batch_size``, each of them one batch; failures name each item."""
        items, n, failures = iter(items), 0, None
        while chunk := list(islice(items, self.config.batch_size)):
            rows = []
            for place, (id_, vector, pairs, meta) in enumerate(chunk):
                filters.check_filter(meta)
                rows.append((place, id_, [float(x) for x in vector], pairs and (list(pairs[0]), [float(x) for x in pairs[1]]), None if meta is None else filters._canonical(meta)))
            done = self.batch_insert(self.spark.createDataFrame(rows, ROW).withColumn("meta", F.parse_json("meta")))
            n += done["inserted_count"]
            failures = done["failures"] if failures is None else failures.union(done["failures"])
        return {"inserted_count": n, "failures": self.spark.createDataFrame([], "id string, error string") if failures is None else failures}

    def batch_insert(self, rows: DataFrame) -> dict:
        """Insert or replace (place, id, vector, sparse, meta) rows in the order of place.

        The good rows are one append to the log; failures are (id, error), a
        table below the collection.  A repeated id counts each time, and the
        last one stays.
        """
        rows = rows.persist()
        try:
            width = self.width or validate.learned_width(rows.where("id is not null and id <> ''"), "place")
            error = validate.error_column(width, self.config.quantization, self.config.metric, sparse="sparse")
            good, failures = validate.split(rows, error)
            failures = self.store.beside("failures", failures)
            n, low, high = good.agg(F.count("*"), F.min("place"), F.max("place")).first()
            if n:
                sparse_ = F.when(~V.sparse_is_empty(F.col("sparse.indices")), F.col("sparse"))
                entries = good.select((F.lit(self.seq + 1) + F.col("place") - F.lit(low)).cast("long").alias("seq"), F.lit("INSERT").alias("action"), "id", V.encode(F.col("vector"), self.config.quantization, self.config.metric).alias("vector"), sparse_.alias("sparse"), "meta")
                before, self.seq, self.width = self.seq, self.seq + 1 + high - low, width
                self.store.append(entries, self.seq)
                self._changed(before)
            return {"inserted_count": n, "failures": failures}
        finally:
            rows.unpersist()

    def delete(self, id: str) -> bool:
        """False, and nothing logged, if the id is unknown."""
        if self.records().where(F.col("id") == id).isEmpty():
            return False
        before, self.seq = self.seq, self.seq + 1
        self.store.append(self.spark.createDataFrame([(self.seq, "DELETE", id, None, None, None)], self.store.log_schema), self.seq)
        self._changed(before)
        return True

    def _changed(self, before: int) -> None:
        """Bring a graph that is in use up to date, and save if it is time."""
        if self.index is not None:
            self._keep(self._updated(self.index, before))
        if time.monotonic() - self.saved >= self.config.auto_save_seconds:
            self.flush()

    def flush(self) -> str:
        """Publish the live records, and the graph, as a snapshot and drop the log."""
        version = self.store.save(self.records(), self._header(), self.seq, self._graph() if self.config.index_type == "hnsw" else None)
        self.saved = time.monotonic()
        return version

    def reset(self) -> None:
        """Empty the collection; a learned width goes, a configured one stays."""
        self.width = self.config.dimensions
        self._keep(None)
        self.store.reset(self._header())

    # ------------------------------------------------------------------ graph

    def _keep(self, index: DataFrame | None) -> None:
        old, self.index = self.index, None if index is None else self.store.beside("graphs", index)
        self.store.forget(old)

    def _updated(self, index: DataFrame, after: int) -> DataFrame:
        """The index with the log's changes after a sequence number."""
        last = changes.latest(self.store.log(after))
        added = last.where("action = 'INSERT'").select("id", "vector", "meta")
        return ann.update(index, self.config, added, last.where("action = 'DELETE'").select("id"), meta=F.to_json("meta"))

    def _built(self) -> DataFrame:
        return ann.build(self.records(), self.config, meta=F.to_json("meta"))

    def _graph(self) -> DataFrame:
        """The graph in use: that of the snapshot with the log's changes, or a new one."""
        if self.index is None:
            stored = self.store.graph()
            self._keep(self._built() if stored is None else self._updated(stored, self.store.header()["seq"]))
        return self.index

    # ---------------------------------------------------------------- reading

    def get(self, id: str) -> dict | None:
        """The record with its vector as floats, or None."""
        rows = self.records().where(F.col("id") == id)
        if self.config.quantization == "scalar":
            rows = rows.withColumn("vector", V.dequantize(F.col("vector")))
        row = rows.withColumn("meta", F.to_json("meta")).first()
        return None if row is None else row.asDict(recursive=True)

    def count(self) -> int:
        return self.records().count()

    def info(self) -> dict:
        return {**self._header(), "count": self.count()}

    def _match(self, where: dict | None):
        return filters.variant_match(F.col("meta"), where) if where else None

    def search(self, vector: list[float], k: int, where: dict | None = None, sparse_query: tuple[list[int], list[float]] | None = None) -> DataFrame:
        """(id, score, meta) of the k best, best first.

        A sparse query blends in keyword scores: of all candidates, or, on a
        graph, of what it finds and of the best by keywords.  With hybrid
        search switched off it is checked and then left out.
        """
        validate.check_query(vector, self.width)
        if sparse_query:
            validate.check_sparse(*sparse_query)
        filters.check_filter(where)
        rows = self.records()
        if k <= 0:
            return rows.select("id", F.lit(0.0).alias("score"), "meta").limit(0)
        one = self.spark.createDataFrame([("q", [float(x) for x in vector], (list(sparse_query[0]), [float(x) for x in sparse_query[1]]) if sparse_query else None)], f"query_id string, vector array<float>, sparse {sparse.SPARSE}")
        if not (sparse_query and sparse_query[0] and self.config.hybrid):
            if self._walks(where):
                found = ann.search(self._graph(), one, k, self.config, where)
            else:
                c = self.config
                return search.top_k(rows, vector, k, c.metric, c.quantization, self._match(where)).select("id", "score", "meta")
        else:
            found = self.search_hybrid(one, k, where)
        return found.select("id", "score").join(rows.select("id", "meta"), "id").orderBy(F.desc("score"), "id").select("id", "score", "meta")

    def _walks(self, where: dict | None) -> bool:
        return self.config.index_type == "hnsw" and (self.config.metadata_index or not where)

    def search_batch(self, queries: DataFrame, k: int, where: dict | None = None) -> DataFrame:
        """(query_id, id, score, rank) for many (query_id, vector) rows."""
        c = self.config
        if self._walks(where):
            return ann.search(self._graph(), queries, k, c, where)
        return search.batch_top_k(self.records(), queries, k, c.metric, c.quantization, self._match(where))

    def search_hybrid(self, queries: DataFrame, k: int, where: dict | None = None) -> DataFrame:
        """(query_id, id, score, rank) for many (query_id, vector, sparse) rows, dense and sparse scores blended."""
        c, match = self.config, self._match(where)
        rows = self.records() if match is None else self.records().where(match)
        if self._walks(where):
            near = ann.search(self._graph(), queries, max(2 * k, c.ef_search), c, where).select("query_id", "id")
            words = sparse.batch_top_k(rows, queries, k).select("query_id", "id")
            scored = near.union(words).distinct().join(rows, "id").join(queries.select("query_id", F.col("vector").alias("_q")), "query_id")
            dense = search.score(F.col("vector"), V.encode(F.col("_q"), c.quantization, c.metric), c.metric, c.quantization)
            return sparse.rescored(scored.select("query_id", "id", dense.alias("score")), rows, queries, k)
        return sparse.hybrid_batch_top_k(rows, queries, k, c.metric, c.quantization)

    def call(self, verb: str, correlation_id: str | None = None, **arguments) -> dict:
        """A verb's answer as {success, data, error}; what the caller got wrong is an error text.

        Results are rows as dictionaries.  The Spark jobs of the call carry the
        correlation id (a new one if none is given) as a tag.
        """
        if verb not in VERBS:
            return {"success": False, "data": None, "error": f"unknown verb {verb!r}"}
        tag = f"call-{correlation_id or uuid.uuid4().hex}"
        self.spark.addTag(tag)
        try:
            data = getattr(self, verb)(**arguments)
            if isinstance(data, dict) and "failures" in data:
                data = {**data, "failures": [r.asDict() for r in data["failures"].collect()]}
            elif isinstance(data, DataFrame):
                kinds = dict(data.dtypes)
                data = [r.asDict(True) for r in data.select(*[F.to_json(c).alias(c) if kinds[c] == "variant" else c for c in data.columns]).collect()]
            return {"success": True, "data": data, "error": None}
        except ValueError as e:
            return {"success": False, "data": None, "error": str(e)}
        finally:
            self.spark.removeTag(tag)

    def postings(self) -> DataFrame:
        return sparse.postings(self.records().where("sparse is not null"))

    def with_config(self, **changed) -> Collection:
        """The same stored collection under other search settings."""
        return Collection(self.spark, self.store.path, replace(self.config, **changed))

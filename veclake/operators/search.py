"""Exact top-k search: Catalyst plans, and an Arrow plan for many queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V
from ..session import on_workers
from .validate import InvalidVectorError, check_k, check_query

#: Bytes of one block of queries: what a broadcast holds at most.
BLOCK_BYTES = 32 << 20
#: Larger k are compared with the number of records first.
HEAP_ROWS = 100_000
#: Vectors that the kernel multiplies at once.
ROWS = 4096


def score(vector: Column, query: Column, metric: str, quantization: str = "none", norm: Column | None = None) -> Column:
    """Similarity of a stored (encoded) vector and an encoded query; ``norm`` is the stored vector's, if it is kept."""
    m = V.resolve(metric)
    if norm is not None and m.scale_invariant and quantization == "none":
        return V.cosine_similarity(vector, query, norm)
    return (m.similarity if quantization == "none" else m.similarity_int8)(vector, query)


def query_column(query: list[float]) -> Column:
    return F.array(*[F.lit(float(x)).cast("float") for x in query])


def top_k(records: DataFrame, query: list[float], k: int, metric: str = "cosine", quantization: str = "none", where: Column | None = None, id_col: str = "id", vector_col: str = "vector", norm_col: str | None = None) -> DataFrame:
    """One query: filter, score, take the k best; equal scores by id.

    Records hold encoded vectors, and their norms if ``norm_col`` names them.  A partial top-k runs in each task, and the
    driver's merge sees k rows of each.
    """
    check_k(k)
    check_query(query)
    rows = records if where is None else records.where(where)
    encoded = V.encode(query_column(query), quantization, metric)
    scored = rows.withColumn("score", score(F.col(vector_col), encoded, metric, quantization, norm_col and F.col(norm_col)))
    best_first = scored.orderBy(F.desc("score"), id_col)
    if k > HEAP_ROWS and k >= rows.count():  # a plain sort, no heap of k rows
        return best_first
    return best_first.limit(k)


def ranked(scored: DataFrame, k: int, id_col: str = "id", query_col: str = "query_id") -> DataFrame:
    """(query, id, score) rows -> the k best of each query with their rank, equal scores by id."""
    w = Window.partitionBy(query_col).orderBy(F.desc("score"), id_col)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _blocks(queries: DataFrame, query_col: str, vector_col: str, metric: str, quantization: str):
    """The encoded queries as (names, matrix) in blocks of a bounded size."""
    size = F.size(vector_col)
    shape = queries.agg(F.count("*").alias("n"), F.max(size).alias("d"), F.min(size).alias("e")).first()
    if not shape["n"]:
        return
    if shape["d"] != shape["e"]:
        raise InvalidVectorError("queries differ in width")
    slim = queries.select(F.col(query_col).alias("q"), V.encode(F.col(vector_col), quantization, metric).alias("v"))
    blocks = -(-shape["n"] * shape["d"] * 8 // BLOCK_BYTES)
    for b in range(blocks):
        part = slim.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).toArrow().combine_chunks()
        if part.num_rows:
            flat = part["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            yield part["q"].combine_chunks(), flat.astype(np.float64).reshape(part.num_rows, -1)


def rows_of(vectors: pa.Array, width: int) -> np.ndarray:
    """A column of vectors as a matrix."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(vectors) * width:
        raise InvalidVectorError("vectors and queries differ in width")
    return flat.astype(np.float64).reshape(len(vectors), width)


def similarities(matrix: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """(queries, rows) of similarities in double."""
    if metric == "cosine":
        size = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(matrix, axis=1)[None, :]
        return np.divide(queries @ matrix.T, size, out=np.zeros(size.shape), where=size > 0)
    square = (queries**2).sum(1)[:, None] + (matrix**2).sum(1)[None, :] - 2 * (queries @ matrix.T)
    near = square < 1e-9 * ((queries**2).sum(1)[:, None] + 1e-300)  # cancellation: sum these directly
    for q, r in zip(*np.nonzero(near), strict=True):
        square[q, r] = ((queries[q] - matrix[r]) ** 2).sum()
    return 1 / (1 + np.sqrt(np.maximum(square, 0)))


def scored(rows: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Similarities in double of rows to a query, or to one each; every row is summed by itself, so equal rows score alike wherever they lie, which products do not promise."""
    if metric == "cosine":
        size = np.sqrt((rows * rows).sum(-1)) * np.sqrt((queries * queries).sum(-1))
        return np.divide((rows * queries).sum(-1), size, out=np.zeros(len(rows)), where=size > 0)
    return 1 / (1 + np.sqrt(((rows - queries) ** 2).sum(-1)))


def least(score: np.ndarray, metric: str) -> np.ndarray:
    """What a product may give for a row that is as similar as one for which it gives ``score``."""
    return score - (1e-11 if metric == "cosine" else 1e-11 + 2e-5 * np.clip(score, 0, 1) * (1 - np.clip(score, 0, 1)))


def best(scores: np.ndarray, ids: pa.Array, k: int) -> np.ndarray:
    """Indices of the k best, ties by id."""
    some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) > k else np.arange(len(scores))
    names = ids.take(pa.array(some)).to_pylist()
    order = sorted(range(len(some)), key=lambda j: (-scores[some[j]], names[j]))[:k]
    return some[order]


def kept(names: pa.Array, k: int, score, again=None, floor=lambda score: score):
    """Rows with an id first -> (query_id, id, score) of the k best for each query in this task.

    ``score`` gives a slice's scores (query, row), NaN where a row is no
    candidate.  ``again`` gives a slice's function (query, rows) of the scores
    that count; a row whose first score is under the ``floor`` of the k-th best
    is not scored again.  What a task holds are k rows a query.
    """

    def run(batches):
        held = [(pa.array([], names.type), np.zeros(0))] * len(names)
        id_type = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids, found = part.column(0), score(part)
                id_type = ids.type
                worst = np.array([s[k - 1] if len(s) >= k else -np.inf for _, s in held])[:, None]
                better, exact = found >= floor(worst), again and again(part)
                for q in np.flatnonzero(better.any(1)).tolist():
                    old_ids, old = held[q]
                    mine = np.flatnonzero(better[q])
                    if len(mine) > k:  # what cannot be among the k best stays out, ties stay in
                        own = found[q, mine]
                        mine = mine[own >= floor(np.partition(own, len(own) - k)[len(own) - k])]
                    every = pa.concat_arrays([old_ids.cast(id_type), ids.take(pa.array(mine))])
                    scores = np.r_[old, found[q][mine] if exact is None else exact(q, mine)]
                    keep = best(scores, every, k)
                    held[q] = every.take(pa.array(keep)), scores[keep]
        if id_type is not None:
            n = [len(s) for _, s in held]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(np.repeat(np.arange(len(names)), n))), pa.concat_arrays([i.cast(id_type) for i, _ in held]), pa.array(np.concatenate([s for _, s in held]))], ["query_id", "id", "score"])

    return run


def in_blocks(rows: DataFrame, query_kind: str, k: int, blocks, scorer, again=None, **more) -> DataFrame:
    """The k best rows of each query, with their rank: each block (names, data) of queries is sent to all tasks, which return k rows a query."""
    schema = f"query_id {query_kind}, id {dict(rows.dtypes)['id']}, score double"
    spark, out = on_workers(rows.sparkSession), None
    for names, data in blocks if k else ():
        shared = spark.sparkContext.broadcast((names, data))

        def run(batches, shared=shared):
            names, data = shared.value
            return kept(names, k, scorer(data), again and again(data), **more)(batches)

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return ranked(spark.createDataFrame([], schema) if out is None else out, k)


def batch_top_k(records: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", quantization: str = "none", where: Column | None = None, id_col: str = "id", vector_col: str = "vector", query_col: str = "query_id", query_vector: str = "vector") -> DataFrame:
    """(query_id, id, score, rank) for many queries, by matrix products over Arrow batches.

    Each block of queries, of a bounded size, is sent to all tasks and each
    task returns k rows a query, so what is shuffled does not depend on the
    number of records.  Those that the products place among the k best are
    scored again one by one, so equal vectors rank by id.  Records hold encoded
    vectors.
    """
    check_k(k)
    V.resolve(metric)
    rows = (records if where is None else records.where(where)).select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))

    def scorer(queries):
        return lambda part: similarities(rows_of(part.column(1), queries.shape[1]), queries, metric)

    def again(queries):
        def of(part):
            matrix = rows_of(part.column(1), queries.shape[1])
            return lambda q, some: scored(matrix[some], queries[q], metric)

        return of

    return in_blocks(rows, dict(queries.dtypes)[query_col], k, _blocks(queries, query_col, query_vector, metric, quantization), scorer, again, floor=lambda score: least(score, metric))


#: Queries of one block that travels inside a plan, and their bytes.
STATED_QUERIES, STATED_BYTES = 1000, 8 << 20


def batch_scores(records: DataFrame, queries: DataFrame, metric: str = "cosine", quantization: str = "none", where: Column | None = None, id_col: str = "id", vector_col: str = "vector", query_col: str = "query_id", query_vector: str = "vector") -> DataFrame:
    """(query_id, id, score) of every record for each query, in expressions alone.

    The queries are broadcast in blocks of a bounded size, each as one array
    row; the scored parts are joined by union, so a set of any size is whole.
    """
    slim = queries.select(F.col(query_col).alias("query_id"), V.encode(F.col(query_vector), quantization, metric).alias("v"))
    size = slim.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("values")).first()
    blocks = 1
    if size["n"] > STATED_QUERIES or 8 * size["values"] > STATED_BYTES:  # dealt by hash: half full on average
        blocks = max(-(-2 * size["n"] // STATED_QUERIES), -(-16 * size["values"] // STATED_BYTES))
    rows = (records if where is None else records.where(where)).select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.lit(0).alias("one"))
    out = None
    for b in range(blocks):
        block = slim if blocks == 1 else slim.where(F.pmod(F.xxhash64("query_id", "v"), F.lit(blocks)) == b)
        listed = block.agg(F.collect_list(F.struct("query_id", "v")).alias("qs")).withColumn("one", F.lit(0))
        every = rows.join(F.broadcast(listed), "one").select("id", "vector", F.explode("qs").alias("q"))
        part = every.select("q.query_id", "id", score(F.col("vector"), F.col("q.v"), metric, quantization).alias("score"))
        out = part if out is None else out.union(part)
    return out


def batch_top_k_native(records: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", quantization: str = "none", **more) -> DataFrame:
    """``batch_scores``, ranked: the k best of each query."""
    check_k(k)
    return ranked(batch_scores(records, queries, metric, quantization, **more), k)


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Share of each query's true k best that was found: (query_id, recall)."""
    hits = truth.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hits.groupBy("query_id").agg((F.count("hit") / F.lit(k)).alias("recall"))

"""Column builders for dense and sparse vectors.

All similarities are computed in double.  A zero vector has cosine similarity
0 with anything.  Vectors of different width, or without elements, are an error.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Share of the dense and of the sparse score in a hybrid score (fixed values).
DENSE_SHARE, SPARSE_SHARE = 0.7, 0.3
#: int8 units of 1.0 (fixed value).
QUANTUM = 127


def _sum(a: Column, kind: str) -> Column:
    return F.aggregate(a, F.lit(0).cast(kind), lambda s, x: s + x)


def dot(a: Column, b: Column, kind: str = "double") -> Column:
    """Inner product; ``kind`` bigint sums int8 vectors exactly."""
    return _sum(F.zip_with(a, b, lambda x, y: x.cast(kind) * y.cast(kind)), kind)


def squared_norm(a: Column, kind: str = "double") -> Column:
    return _sum(F.transform(a, lambda x: x.cast(kind) * x.cast(kind)), kind)


def norm(a: Column) -> Column:
    """L2 norm; worth a column of its own, as every cosine needs it."""
    return F.sqrt(squared_norm(a))


def squared_distance(a: Column, b: Column, kind: str = "double") -> Column:
    """Squared L2 distance: ranks like the distance, without the root."""
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast(kind) - y.cast(kind)) * (x.cast(kind) - y.cast(kind))), kind)


def _same_width(a: Column, b: Column, value: Column) -> Column:
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(fits | a.isNull() | b.isNull(), value).otherwise(F.raise_error(F.lit("vectors differ in width or are empty")).cast("double"))


def cosine_similarity(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return _same_width(a, b, F.when(size == 0, 0.0).otherwise(dot(a, b) / size))


def cosine_similarity_int8(a: Column, b: Column) -> Column:
    """Sums are whole numbers, so exact; only the last division rounds."""
    size = F.sqrt(squared_norm(a, "bigint").cast("double")) * F.sqrt(squared_norm(b, "bigint").cast("double"))
    return _same_width(a, b, F.when(size == 0, 0.0).otherwise(dot(a, b, "bigint").cast("double") / size))


def euclidean_similarity(a: Column, b: Column) -> Column:
    return _same_width(a, b, 1 / (1 + F.sqrt(squared_distance(a, b))))


def euclidean_similarity_int8(a: Column, b: Column) -> Column:
    """In int8 units: about 127 times the distance of the float vectors."""
    return _same_width(a, b, 1 / (1 + F.sqrt(squared_distance(a, b, "bigint").cast("double"))))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


def euclidean_distance(a: Column, b: Column) -> Column:
    return _same_width(a, b, F.sqrt(squared_distance(a, b)))


def normalize(a: Column) -> Column:
    """Unit vector in float32: norm summed in double, cut to float, float division; zero stays."""
    length = norm(a).cast("float")
    return F.when(length == 0, a).otherwise(F.transform(a, lambda x: (x / length).cast("float")))


def quantize(a: Column) -> Column:
    """int8: clamped to [-1, 1], times 127 in float32, cut toward zero."""
    return F.transform(a, lambda x: (F.greatest(F.lit(-1.0).cast("float"), F.least(F.lit(1.0).cast("float"), x.cast("float"))) * F.lit(QUANTUM).cast("float")).cast("tinyint"))


def dequantize(a: Column) -> Column:
    return F.transform(a, lambda x: (x.cast("float") / F.lit(QUANTUM).cast("float")).cast("float"))


def out_of_range(a: Column) -> Column:
    """First dimension outside [-1, 1], from 0, or null."""
    at = F.array_position(F.transform(a, lambda x: (F.abs(x) > 1) | F.isnan(x)), F.lit(True))
    return F.when(at > 0, at - 1)


def encode(a: Column, quantization: str, metric: str) -> Column:
    """How vectors and queries are stored: as they are, or int8 (normalised first if the metric ignores length)."""
    if quantization == "none":
        return a
    return quantize(normalize(a) if METRICS[metric].scale_invariant else a)


def sparse_dot(a_indices: Column, a_values: Column, b_indices: Column, b_values: Column) -> Column:
    """Inner product of two sparse vectors with ascending indices."""
    other = F.map_from_arrays(b_indices, b_values)
    return _sum(F.zip_with(a_indices, a_values, lambda i, w: w.cast("double") * F.coalesce(F.try_element_at(other, i).cast("double"), F.lit(0.0))), "double")


def sparse_is_empty(indices: Column) -> Column:
    return F.coalesce(F.size(indices) <= 0, F.lit(True))


def hybrid_score(dense: Column, sparse: Column) -> Column:
    """0.7 dense + 0.3 sparse; a missing or negative sparse score counts as 0."""
    return DENSE_SHARE * dense + SPARSE_SHARE * F.greatest(F.coalesce(sparse, F.lit(0.0)), F.lit(0.0))


@dataclass(frozen=True)
class Metric:
    """A metric's Column builders; a new entry in METRICS is a new metric."""

    name: str
    scale_invariant: bool
    similarity: Callable[[Column, Column], Column]
    similarity_int8: Callable[[Column, Column], Column]
    distance: Callable[[Column, Column], Column]
    score: Callable[[Column], Column]  # of a distance


METRICS = {
    "cosine": Metric("cosine", True, cosine_similarity, cosine_similarity_int8, cosine_distance, lambda d: 1 - d),
    "euclidean": Metric("euclidean", False, euclidean_similarity, euclidean_similarity_int8, euclidean_distance, lambda d: 1 / (1 + d)),
}


def resolve(name: str) -> Metric:
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(sorted(METRICS))}")
    return METRICS[name]


def is_known(name: str) -> bool:
    return name in METRICS


def metric_names() -> list[str]:
    return sorted(METRICS)

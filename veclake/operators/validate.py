"""Checks of records and queries, as Columns that name what is wrong."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import METRICS, out_of_range


class InvalidVectorError(ValueError):
    """What the caller sent cannot be stored or searched for."""


def check_k(k: int) -> None:
    if k < 0:
        raise ValueError("k must not be negative")


def check_query(query: list[float], width: int = 0) -> None:
    if not query:
        raise InvalidVectorError("vector is empty")
    if width and len(query) != width:
        raise InvalidVectorError(f"vector has {len(query)} dimensions, expected {width}")
    for i, x in enumerate(query):
        if not math.isfinite(x):
            raise InvalidVectorError(f"vector[{i}] is not finite")


def check_sparse(indices: list[int], values: list[float]) -> None:
    if len(indices) != len(values):
        raise InvalidVectorError("sparse indices and values differ in length")
    if any(a >= b for a, b in zip(indices, indices[1:], strict=False)):
        raise InvalidVectorError("sparse indices must ascend strictly")
    for i, x in enumerate(values):
        if not math.isfinite(x):
            raise InvalidVectorError(f"sparse value {i} is not finite")


def _bad_at(a: Column) -> Column:
    at = F.array_position(F.transform(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
    return F.when(at > 0, at - 1)


def error_column(width: int | Column, quantization: str = "none", metric: str = "cosine", vector: str = "vector", sparse: str | None = None, id_col: str = "id") -> Column:
    """Null for a good record, else the first thing wrong with it."""
    v = F.col(vector)
    checks = [
        (F.col(id_col).isNull() | (F.col(id_col).cast("string") == ""), F.lit("id is required")),
        (v.isNull() | (F.size(v) == 0), F.lit("vector is empty")),
        ((F.lit(width) > 0) & (F.size(v) != F.lit(width)), F.concat(F.lit("vector has "), F.size(v).cast("string"), F.lit(" dimensions"))),
        (_bad_at(v).isNotNull(), F.concat(F.lit("vector["), _bad_at(v).cast("string"), F.lit("] is not finite"))),
    ]
    if sparse:
        i, w = F.col(f"{sparse}.indices"), F.col(f"{sparse}.values")
        steps = F.exists(F.arrays_zip(F.slice(i, 1, F.greatest(F.size(i) - 1, F.lit(0))).alias("a"), F.slice(i, 2, F.greatest(F.size(i) - 1, F.lit(0))).alias("b")), lambda s: s["a"] >= s["b"])
        checks += [
            (F.coalesce(F.size(i), F.lit(0)) != F.coalesce(F.size(w), F.lit(0)), F.lit("sparse indices and values differ in length")),
            (F.coalesce(steps, F.lit(False)), F.lit("sparse indices must ascend strictly")),
            (_bad_at(w).isNotNull(), F.concat(F.lit("sparse value "), _bad_at(w).cast("string"), F.lit(" is not finite"))),
        ]
    if quantization == "scalar" and not METRICS[metric].scale_invariant:
        checks.append((out_of_range(v).isNotNull(), F.concat(F.lit("dimension "), out_of_range(v).cast("string"), F.lit(" is outside [-1, 1]"))))
    out = F.lit(None).cast("string")
    for bad, message in reversed(checks):
        out = F.when(bad, message).otherwise(out)
    return out


def learned_width(records: DataFrame, order: str, vector: str = "vector") -> int:
    """Width of the first record, in order, whose vector alone is sound; 0 without one."""
    sound = F.col(vector).isNotNull() & (F.size(vector) > 0) & _bad_at(F.col(vector)).isNull()
    first = records.where(sound).agg(F.min_by(F.size(vector), order)).first()[0]
    return first or 0


def split(records: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """(good records, failures(id, error)); a failure leaves no trace in the good ones."""
    marked = records.withColumn("error", error)
    return marked.where("error is null").drop("error"), marked.where("error is not null").select("id", "error")

"""Schemas of a collection's tables."""

from __future__ import annotations

from pyspark.sql import types as T

SPARSE = T.StructType([T.StructField("indices", T.ArrayType(T.LongType())), T.StructField("values", T.ArrayType(T.FloatType()))])


def records(id_type: T.DataType | None = None, meta: T.DataType | None = None) -> T.StructType:
    """id, vector, sparse and metadata (VARIANT, or a struct of typed columns)."""
    return T.StructType([
        T.StructField("id", id_type or T.StringType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("sparse", SPARSE),
        T.StructField("meta", meta or T.VariantType()),
    ])


def changelog(id_type: T.DataType | None = None, meta: T.DataType | None = None) -> T.StructType:
    """Records with their place in the log and INSERT or DELETE."""
    return T.StructType([T.StructField("seq", T.LongType()), T.StructField("action", T.StringType()), *records(id_type, meta).fields])


#: JSON bodies of single inserts and batches.
INSERT_BODY = "id string, vector array<float>, sparse_vector struct<indices:array<bigint>,values:array<float>>, metadata variant"
BATCH_BODY = "vectors array<struct<id:string,vector:array<float>,sparse_vector:struct<indices:array<bigint>,values:array<float>>,metadata:variant>>"

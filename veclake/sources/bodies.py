"""JSON request bodies as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import BATCH_BODY, INSERT_BODY


def _records(rows: DataFrame) -> DataFrame:
    return rows.select("id", "vector", F.when(F.size("sparse_vector.indices") > 0, F.col("sparse_vector")).alias("sparse"), F.col("metadata").alias("meta"))


def inserts(spark: SparkSession, path: str) -> DataFrame:
    """Lines of single insert bodies -> records."""
    return _records(spark.read.schema(INSERT_BODY).json(path))


def batches(spark: SparkSession, path: str) -> DataFrame:
    """Lines of batch bodies -> records; a body without any is an error."""
    some = F.when(F.size("vectors") > 0, F.col("vectors")).otherwise(F.raise_error(F.lit("vectors must not be empty")))
    return _records(spark.read.schema(BATCH_BODY).json(path).select(F.explode(some).alias("v")).select("v.*"))


def results_json(results: DataFrame) -> DataFrame:
    """Search results as JSON lines; absent metadata is left out."""
    return results.select(F.to_json(F.struct(*results.columns), {"ignoreNullFields": "true"}).alias("value"))

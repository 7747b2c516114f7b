"""Metadata as postings, allowlists, and how selective a filter is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def meta_postings(records: DataFrame, fields: list[str], id_col: str = "id") -> DataFrame:
    """(field, value, id): the canonical JSON text of each field of each record."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.get_json_object(F.to_json(F.struct(F.col(f).alias("v"))), "$.v").alias("value")) for f in fields])
    return records.select(F.col(id_col).alias("id"), F.explode(each).alias("p")).select("p.field", "p.value", "id")


def allowlist(posted: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Ids whose postings meet all (field, text value) pairs; all ids without any."""
    if not filters:
        return posted.select("id").distinct()
    pairs = None
    for f, v in filters.items():
        one = (F.col("field") == f) & (F.col("value") == v)
        pairs = one if pairs is None else pairs | one
    return posted.where(pairs).groupBy("id").agg(F.countDistinct("field").alias("n")).where(F.col("n") == len(filters)).select("id")


def selectivity(records: DataFrame, match: Column) -> DataFrame:
    """(n, n_match, selectivity) of a filter."""
    hit = F.sum(match.cast("int").cast("long"))
    return records.agg(F.count("*").alias("n"), F.coalesce(hit, F.lit(0)).alias("n_match"), F.coalesce(hit / F.count("*"), F.lit(0.0)).alias("selectivity"))

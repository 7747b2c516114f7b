"""Corpus pipeline: quality rules, exact dedup, near-dedup, mixing, packing.

Each stage reads all that the one before kept and returns the columns of
``documents``, but for the last, which returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veclake.llm.common import table, written
from veclake.llm.exact_dedup import distinct_texts
from veclake.llm.mixing import mixed_documents
from veclake.llm.packing import pack
from veclake.llm.quality import quality_filter
from veclake.llm.registry import BYTE_BPE, MIX_BYTES, MIX_SEED, MIX_WEIGHTS, mix_domain
from veclake.llm.simhash import distinct_by_both
from veclake.session import on_workers

#: Part of the deduplicated tokens that the mixture takes.  One epoch: a second reading would bring copies back.
SHARE, EPOCHS = 0.6, 1


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the bounds of their language and source.

    Null texts fail; a null language or source is a group of its own; repeated
    rows are judged each; extra columns go along; an empty table stays empty.
    """
    return quality_filter(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z the one with the largest id.

    Null counts as an empty text and as the smallest id; rows that repeat id
    and text stay together; extra columns go along; an empty table stays empty.
    """
    on_workers(spark)
    return distinct_texts(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Groups by the links of operator 4's contract (3-word shingles, 3 bits) and of 5-word shingles 0.8 similar or more together.

    The smallest id of a group stays, null being the smallest; rows that repeat
    id and text stay together; texts without words are one group; extra columns
    go along; an empty table stays empty.
    """
    on_workers(spark)
    return distinct_by_both(docs, shingle=3, radius=3, wide_shingle=5, similarity=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that fit the budgets of their domain, language and source, in a seeded order.

    Null names are names like any other; rows that repeat an id are taken or
    left together; extra columns go along; an empty table stays empty.
    """
    return mixed_documents(docs, mix_domain(), MIX_WEIGHTS, SHARE, EPOCHS, MIX_SEED, MIX_BYTES)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences that all the documents fill, one row each; an empty table gives none."""
    on_workers(spark)
    return pack(docs, BYTE_BPE)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mixing),
    ("packing", packing),
]

#: SQL expresses neither the fingerprints nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

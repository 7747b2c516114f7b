"""The queries of this package, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .common import table
from .exact_dedup import exact_dedup
from .language_id import by_id, language_id
from .mixing import mix
from .packing import pack
from .quality import quality_rules
from .secret_scan import secret_scan
from .simhash import near_duplicates
from .substring_dedup import substring_dedup
from .token_counts import token_counts
from .url_filter import url_filter

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
#: (host and path prefix, verdict)
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
#: Target weights of the mixture at each level; a name that is not stated has weight 1.
MIX_WEIGHTS = {"domain": {"d0": 3, "d1": 2, "d2": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 1}}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.5, 2, 1
#: UTF-8 bytes of a token of byte_bpe_50k by language (None: others), measured by operator 3 on the 0.1 tables.
MIX_BYTES = {"en": 2.63, "de": 2.46, "fr": 2.38, "es": 2.24, None: 2.52}


def mix_domain() -> Column:
    """The domain of a source: its number modulo 3, ``other`` without one."""
    number = F.try_to_number(F.right(F.regexp_extract("source", "([0-9]+)$", 1), F.lit(9)), F.lit("999999999"))
    return F.coalesce(F.concat(F.lit("d"), (number.cast("long") % 3).cast("string")), F.lit("other"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), BYTE_BPE)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), BYTE_BPE)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=3)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), URL_RULES)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), mix_domain(), MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED, bytes_per_token=MIX_BYTES)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id(docs, by_id(docs["doc_id"]))


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing,
        op2_quality_rules,
        op3_token_counts,
        op4_simhash_near_dedup,
        op5_exact_dedup,
        op6_substring_dedup,
        op7_url_filter,
        op8_mixing,
        op9_secret_scan,
        op10_language_id,
    )
}
ORACLES: dict[str, str] = {
    "op2_quality_rules": oracles.quality(),
    "op5_exact_dedup": oracles.EXACT_DEDUP,
    "op6_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op8_mixing": oracles.mixing(MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED, MIX_BYTES),
}

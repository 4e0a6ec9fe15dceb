"""The queries of this package, by the names under which the entry module registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, decontaminate, mixing, pii, quality, secrets, sharding, simhash, tokens, toxicity
from .common import read

#: A ranks file of a byte-level BPE vocabulary, on every node.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A deployment passes its own secret to pii.pseudonymise.
KEY = b"key of the registered query"
#: Small shards, for quick reads of a part; the pipeline writes greater ones.
SHARD_CHARS = 500_000
#: Shares of the tokens by language, the domain of the registered query.
WEIGHTS = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), weights=WEIGHTS)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.passages(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.duplicates(read(spark, sf_dir, "documents"))


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read(spark, sf_dir, "documents"), VOCABULARY)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(read(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(read(spark, sf_dir, "documents"), key=KEY)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(read(spark, sf_dir, "embeddings"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(read(spark, sf_dir, "documents"), target=SHARD_CHARS)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_mixing, op2_decontaminate, op3_simhash, op4_tokens, op5_secrets, op6_quality, op7_pii, op8_toxicity, op9_ann, op10_sharding)}


def oracle_sql() -> dict[str, str]:
    return {"op10_sharding": sharding.oracle_sql(SHARD_CHARS)}

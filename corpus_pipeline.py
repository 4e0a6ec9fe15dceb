"""The corpus pipeline: quality, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its output is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import decontaminate, mixing, quality, sharding, simhash
from siltstone.llm.common import read
from siltstone.operators.lineage import shared_folder


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without what the quality classifier rejects. Null and empty texts stand by chance; a null id draws as id 0."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of least id, or one without an id; texts without a word stay."""
    return simhash.keep_first(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a passage of the benchmark. Null and empty texts stay."""
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the weights of its language ask; rows that repeat an id are copies from here on."""
    return mixing.mix(docs, read(spark, sf_dir, "labels"))


def in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents along the curve, with their shard. Nulls count as the empty name and the empty text."""
    return sharding.sharded(docs)


STAGES = [
    ("quality classifier", good),
    ("near duplicates", first_copies),
    ("decontamination", clean),
    ("mixing", mixed),
    ("sharding", in_shards),
]

#: The classifiers are trained numerically and the duplicates found by fingerprints: SQL has no form of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between two, the rows are written in the shared checkpoint folder.

    What a stage wrote is deleted once the next one has read it; the last two stay, since the result
    still reads them.
    """
    docs = read(spark, sf_dir, "documents")
    base = os.path.join(shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{base}/{k}")
            docs = spark.read.parquet(f"{base}/{k}")
            if k:
                old = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{k - 1}")
                old.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(old, True)
    return docs

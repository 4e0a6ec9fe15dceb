"""What the operators share: lineage cuts, bounded samples, column narrowing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut  # noqa: F401


def narrow(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Only the given columns, under internal names: {internal: own}. Extra columns cannot clash."""
    return df.select(*[F.col(f"`{own}`").alias(name) for name, own in columns.items()])


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many signs _ before it as keep it apart from the columns of ``df``."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def bounded_sample(labels: DataFrame, limit: int, seed: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``limit`` rows of ``labels`` with an id, chosen by the least hash of the id.

    Repeated ids count once (the greatest row wins, so that the choice is defined). The result is
    bounded by ``limit`` whatever the size of the input and may therefore be broadcast.
    """
    others = [c for c in labels.columns if c != id_col]
    one = labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(F.struct(*others)).alias("_o")).select(id_col, "_o.*")
    return one.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(limit)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


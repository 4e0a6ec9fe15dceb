"""Lineage cuts for iterative operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, else that of its configuration; a temporary one only in a local session."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="siltstone-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again, without lineage.

    Written as Parquet, so that the plans that read it know its size: a checkpoint hands on what was
    estimated for the plan it replaces. That is too little after an explode or a Python step, so that
    large tables were broadcast, and a product of products after joins in rounds.
    """
    folder = os.path.join(shared_folder(df.sparkSession), f"cut-{uuid.uuid4().hex}")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)

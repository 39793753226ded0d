"""Intermediate tables in the cluster's shared checkpoint folder.

Iterative steps (key tiers, one-to-one resolution) write each round as a
parquet table and read it back. That cuts the lineage, survives the loss of
an executor, keeps column pruning, and gives the optimizer real sizes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Only for a local master without the setting.
LOCAL_FOLDER = "file:///tmp/checkpoints/twinfold"


def stage_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a fixed folder only where a local master leaves it unset."""
    shared = spark.conf.get("spark.checkpoint.dir", "")
    if shared:
        return shared.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return LOCAL_FOLDER


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a scan of what was written."""
    path = f"{stage_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

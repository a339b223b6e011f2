"""Tables written on the way of a long job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the cluster's shared folder (spark.checkpoint.dir). Only a local session may leave that setting out."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints/{spark.sparkContext.applicationId}"
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def settled(df: DataFrame, tag: str = "step") -> DataFrame:
    """df written to the cluster's shared folder and read again, which ends its lineage and lets lost executors cost no
    more than a read."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Cutting a plan where later steps must see the same rows however often they run."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names in spark.checkpoint.dir; locally, without one, a new temporary folder."""
    context = spark.sparkContext
    if not context.getConf().get("spark.checkpoint.dir") and not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tiza-"))
    return context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()


def new_folder(spark: SparkSession) -> str:
    """The URI of a folder that doesn't exist yet, which driver and executors share."""
    return f"{_folder(spark).rstrip('/')}/tiza-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder, so that later steps see the rows that this one made."""
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)

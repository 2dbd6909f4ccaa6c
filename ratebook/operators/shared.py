"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

__all__ = ["held", "scratch"]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a local one only where none is set and all run in one JVM."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="ratebook-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def held(df: DataFrame, name: str = "held") -> DataFrame:
    """df written to the shared folder as Parquet and read again: several uses compute it once, and none depends on an executor's disk."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

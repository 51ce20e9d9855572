"""Cutting the lineage of iterative plans with tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def saved(df: DataFrame) -> DataFrame:
    """df written as Parquet under spark.checkpoint.dir and read back; a temporary folder only where that is unset and Spark is local."""
    path = shared_path(df.sparkSession, "p")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _own.setdefault("dir", tempfile.mkdtemp(prefix="kmerloom-"))
    return f"{root}/{kind}-{uuid.uuid4().hex}"

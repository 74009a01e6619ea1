"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Let the Python workers of this session import this package (a cluster may use --py-files instead)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    have = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *have])


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder of spark.checkpoint.dir."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def shared(spark: SparkSession) -> str:
    """The folder of this session's checkpoints, which all executors see; only a local session gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """The rows, worked out once: written compressed to the shared folder and read from there by every step that needs them."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """The path of a new folder there."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"

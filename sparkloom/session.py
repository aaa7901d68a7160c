"""Session helpers shared by the engine."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def local_folder(spark: SparkSession, prefix: str) -> str:
    """A temporary folder of this machine, for tests on one machine; a cluster has to name a shared one."""
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix=prefix)


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df.checkpoint()`` in the folder the cluster names; a local one only where none is set.

    The folder comes from ``spark.checkpoint.dir``, which all executors share, so a lost executor
    loses nothing. Without that setting a local session (tests) uses a temporary folder of this machine.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or local_folder(spark, "checkpoint-"))
    return df.checkpoint(eager)


Query = Callable[[SparkSession, str], DataFrame]

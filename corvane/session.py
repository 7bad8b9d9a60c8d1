"""What every module needs from the session: Python path of the workers, checkpoints, tables."""

from __future__ import annotations

import ctypes
import tempfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def workers_can_import(spark: SparkSession) -> None:
    """Let Python workers import this package when it isn't installed on them (a cluster uses --py-files)."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([ROOT, *paths])


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a folder of our own only in local mode, where it is unset."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="corvane-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder once, so that nothing behind them is computed again or lost."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def give_back() -> None:
    """At a Python task's end: memory that is free but still the process's goes back, as workers live on and share the executor's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str, heavy: bool = False) -> DataFrame:
    """A table of the driver. heavy: for work that takes long a row; files too few for all cores are then dealt out over them.

    Where there are at least as many splits as cores, as in any large table, nothing is shuffled.
    """
    workers_can_import(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if heavy and df.rdd.getNumPartitions() < cores else df

"""Session helpers: a tuned builder and lineage cutting in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the engine's defaults; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.master(master).appName("tidemark")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it.

    Where none is named, a local session takes a folder of its machine, which all
    of it shares; a cluster is refused.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "tidemark-shared")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for a written table or a stream's state below the shared folder."""
    return f"{shared(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` by a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared(df.sparkSession))
    return df.checkpoint(eager=True)


_kept: list[DataFrame] = []


def keep(df: DataFrame, now: bool = False) -> DataFrame:
    """Keep what several branches of one plan read, in memory and on disk; lost parts are computed again. :func:`release` lets go of it.

    With ``now`` it is worked out at once: branches that start together would else each begin with it.
    """
    _kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    if now:
        df.count()
    return df


def release() -> None:
    """Let go of all that :func:`keep` keeps; results computed later work it out again."""
    while _kept:
        _kept.pop().unpersist()

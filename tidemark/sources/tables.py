"""Parquet table sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``; columns and filters are pruned by the scan."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder`` as a stream of files, be it one file or a folder of parts."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    still = spark.read.parquet(path)
    reader = spark.readStream.schema(still.schema)
    if any(part.rstrip("/").endswith(f"/{name}.parquet") for part in still.inputFiles()):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return reader.parquet(path)

"""Tables by name under one folder, whatever they are stored as."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` (a file or a folder of files). Its times have no zone; :func:`tapeloom.functions.times.micros` reads them as UTC."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")

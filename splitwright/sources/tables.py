"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table; whether it is a file or a folder of files makes no difference. Sees to it that executors know this package."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")

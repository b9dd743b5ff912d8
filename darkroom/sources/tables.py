"""Reading the archive's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The Parquet table ``name`` (a file or a directory) below ``base``."""
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")

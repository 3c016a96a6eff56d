"""Stored input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table. ``spark.sql.files.minPartitionNum`` spreads a small one over more tasks."""
    return spark.read.parquet(path)

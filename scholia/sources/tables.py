"""Parquet tables of a folder, read by Spark only, so any store that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of a folder with one ``<name>.parquet`` per table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")

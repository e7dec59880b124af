"""Readers of the parquet tables that the queries work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by Spark's own reader, so that any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

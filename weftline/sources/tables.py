"""Parquet tables of one directory, read by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table ``name`` of ``directory``; a file or a folder of part files. Columns are pruned by what the plan uses."""
    return spark.read.parquet(f"{directory}/{name}.parquet")

"""Named tables of a dataset folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan ``<sf_dir>/<name>.parquet``; any path Spark's readers open will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

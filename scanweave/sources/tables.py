"""Reading tables."""

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet table; how it is split is left to the session's settings."""
    return spark.read.parquet(path)

"""Reading the parquet tables of a data folder; one file or a folder of parts per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstrata.session import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")

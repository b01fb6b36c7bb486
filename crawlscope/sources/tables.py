"""Readers for the recorded crawl tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def read_pages(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "pages")

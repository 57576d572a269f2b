"""Catalog tables with JSON payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONFIG = "colorization_image string, sample_radius double, translate_z double, max_features_per_tile double"


def parse_pipelines(pipelines: DataFrame) -> DataFrame:
    """Pipelines with the keys of their configuration and the tileset of their result as columns."""
    rows = pipelines.withColumn("_config", F.from_json("data", CONFIG.replace(" double", " string")))
    numbers = [F.col(f"_config.{c.split()[0]}").try_cast(c.split()[1]).alias(c.split()[0]) for c in CONFIG.split(", ")]
    return rows.select("*", *numbers, F.get_json_object("task_result", "$.tileset").alias("tileset")).drop("_config")


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A catalog table of a database, read by key ranges in parallel."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts)

"""Other files: tagged Parquet, inferred CSV, JSON arrays, text landing."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .schemas import SCHEMES


def read_tagged(spark: SparkSession, paths: dict[str, str], tag: str = "lang") -> DataFrame:
    """One Parquet path per tag value, unioned with the value as a column."""
    parts = [spark.read.parquet(path).withColumn(tag, F.lit(value)) for value, path in paths.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_csv_inferred(spark: SparkSession, path: str, sampling_ratio: float = 1.0) -> DataFrame:
    """Header CSV with inferred types; inference reads the files once more."""
    return spark.read.csv(path, header=True, inferSchema=True, samplingRatio=sampling_ratio)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType = SCHEMES) -> DataFrame:
    """A JSON array of records."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def land_as_string(df: DataFrame) -> DataFrame:
    return df.select([F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def create_layers(spark: SparkSession, root: str | None = None, layers=("bronze", "silver", "gold")) -> list[str]:
    """One database per layer; with ``root`` its tables live under that folder."""
    for layer in layers:
        location = f" LOCATION '{root}/{layer}'" if root else ""
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {layer}{location}")
    return list(layers)

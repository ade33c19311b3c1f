"""Reading datasets: Parquet, CSV seeds and catalog tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, types as T


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """A seed: CSV with a header. Without a schema, one more pass infers the types."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_folder(spark: SparkSession, folder: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """One dataset per ``<folder>/<name>.parquet``."""
    return {n: read_parquet(spark, f"{folder.rstrip('/')}/{n}.parquet") for n in names}


def row_count(df: DataFrame) -> int:
    return df.count()

"""Reporting extracts as folders of CSV or Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.sources.tables import path_exists


def write_extract(df: DataFrame, path: str, overwrite: bool = False, fmt: str = "csv") -> bool:
    """Write unless it is there already; ``overwrite`` replaces it.  True when something was written.

    Extracts are reports of a few rows or user-grain tables; Spark writes them in parallel, one file per
    task, and the folder is the extract.
    """
    if not overwrite and path_exists(df.sparkSession, path):
        return False
    writer = df.write.mode("overwrite" if overwrite else "ignore").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)
    return True


def load_extract(
    spark: SparkSession, path: str, schema: T.StructType | str, required: bool = True, fmt: str = "csv"
) -> DataFrame:
    """Read an extract with its schema; a missing optional one is an empty frame."""
    if not path_exists(spark, path):
        if required:
            raise FileNotFoundError(f"Missing extract: {path}")
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path)

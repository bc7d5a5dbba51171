"""Table scans with declared schemas, SQL over named frames, catalogue listing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.schemas import SOURCE_TABLES


def read_table(spark: SparkSession, directory: str, name: str, schema: T.StructType | None = None) -> DataFrame:
    """Scan ``<directory>/<name>.parquet`` (a file or a folder) with its declared schema."""
    return spark.read.schema(schema or SOURCE_TABLES[name]).parquet(f"{directory.rstrip('/')}/{name}.parquet")


def read_sources(spark: SparkSession, directory: str) -> dict[str, DataFrame]:
    return {name: read_table(spark, directory, name, schema) for name, schema in SOURCE_TABLES.items()}


def run_sql(
    spark: SparkSession, text: str, views: Mapping[str, DataFrame] | None = None, args: Mapping | None = None
) -> DataFrame:
    """Run SQL text over named frames; ``{name}`` in the text stands for a frame, ``:name`` for a value."""
    return spark.sql(text, args=dict(args) if args else None, **(views or {}))


def run_sql_file(
    spark: SparkSession, path: str, views: Mapping[str, DataFrame] | None = None, args: Mapping | None = None
) -> DataFrame:
    """``run_sql`` on a file in any folder Spark can read; FileNotFoundError when it is not there."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"Missing SQL file: {path}")
    return run_sql(spark, spark.read.text(path, wholetext=True).head()[0], views, args)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system the path belongs to."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def catalog_info(spark: SparkSession, tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """``(table, position, column, type)`` of the given frames, or of the session's tables and views."""
    frames = tables if tables is not None else {t.name: spark.table(t.name) for t in spark.catalog.listTables()}
    rows = [
        (name, i, field.name, field.dataType.simpleString())
        for name, df in frames.items()
        for i, field in enumerate(df.schema)
    ]
    return spark.createDataFrame(rows, "table string, position int, column string, type string")

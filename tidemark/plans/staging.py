"""Materialising a shared step so it survives lost executors and is read many times."""

from __future__ import annotations

import uuid
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_written: dict[str, list[str]] = defaultdict(list)


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate data that all executors reach.

    It is what the cluster names in ``spark.checkpoint.dir``.  Where that is unset it is a folder of the session's
    warehouse, which is shared as well, and is set for the session.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if not named:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"
        spark.conf.set(CHECKPOINT_CONF, named)
    return named.rstrip("/")


def staged(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends at the files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _written[spark.sparkContext.applicationId].append(path)
    return spark.read.schema(df.schema).parquet(path)


def release_staged(spark: SparkSession) -> int:
    """Delete the folders this application staged; call it when nothing reads them any more."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
    return len(paths)


def build_mart(mart: DataFrame, table: str, buckets: int | None = None, key: str = "user_id") -> DataFrame:
    """Save the user mart as a table, bucketed by user so later joins on it need no shuffle of the mart."""
    writer = mart.write.mode("overwrite").format("parquet")
    if buckets:
        writer = writer.bucketBy(buckets, key).sortBy(key)
    writer.saveAsTable(table)
    return mart.sparkSession.table(table)

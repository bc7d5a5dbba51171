"""Row counts, date coverage and balances over tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import ratio
from tidemark.operators.quality import union


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table; Parquet answers a bare count from its footers."""
    return union(
        [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows") for n, df in tables.items()]
    )


def date_coverage(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """First and last date and rows per table."""

    def one(name: str, df: DataFrame, column: str) -> DataFrame:
        found = df.agg(
            F.min(column).cast("string").alias("min_date"),
            F.max(column).cast("string").alias("max_date"),
            F.count(F.lit(1)).alias("rows"),
        )
        return found.select(F.lit(name).alias("table_name"), "min_date", "max_date", "rows")

    return union([one(n, df, c) for n, (df, c) in tables.items()])


def balance(df: DataFrame, column: str) -> DataFrame:
    """Value counts and shares; the total is a scalar sub-query over the counted values."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows").alias("total"))
    return counts.withColumn("share", ratio(F.col("rows"), total.scalar())).orderBy(F.desc("rows"), column)


def head(df: DataFrame, n: int, *order) -> DataFrame:
    """First rows of an order: a top-n per task, then of those."""
    return df.orderBy(*order).limit(n)


def tail(df: DataFrame, n: int, order: str) -> DataFrame:
    """Last rows of an ascending order, given in that order."""
    return df.orderBy(F.desc(order)).limit(n).orderBy(order)

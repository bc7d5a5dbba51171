"""Keep-first de-duplication by business key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EVENT_KEY = ("user_id", "session_id", "event_timestamp", "event_name")


def dedupe_by_key(df: DataFrame, keys: Sequence[str] = EVENT_KEY, order: str = "event_id") -> DataFrame:
    """One row per key, the one with the lowest ``order``; NULL keys form a group of their own.

    The ``== 1`` filter lets Spark keep one row per key *before* the shuffle (WindowGroupLimit), so a key
    that holds a large share of the rows reaches its task as one row per input split.
    """
    position = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    return df.withColumn("_position", position).where("_position = 1").drop("_position")


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key, combined on the map side."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def dedupe_report(df: DataFrame, keys: Sequence[str] = EVENT_KEY) -> DataFrame:
    """Raw, kept and removed row counts of ``dedupe_by_key`` in one pass over the keys."""
    return key_counts(df, keys).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("raw_events"),
        F.count(F.lit(1)).alias("clean_events"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("removed_duplicates"),
    )

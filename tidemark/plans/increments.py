"""The mart kept up to date by days: partial states of a user's completed exchanges, stored per day and merged.

``days`` holds one row for each user and day, in a folder of each day.  An increment rewrites the folders of its own days and
no others, so running it again changes nothing.  ``totals`` holds one row for each user up to a day.  An increment starts
from the newest totals before its first day and merges only the days after that: an increment at the end reads its own
days, one that corrects an old day reads the days since.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numeric import any_flag
from tidemark.operators import lifecycle
from tidemark.plans.staging import staged

_STATE = "user_id long, first_at timestamp_ntz, last_at timestamp_ntz, n long, volume decimal(38,8), target int"
_DAY = _STATE + ", day date"


def _merged(states: DataFrame, *by: str) -> DataFrame:
    return states.groupBy("user_id", *by).agg(
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
        F.sum("n").alias("n"),
        F.sum("volume").cast("decimal(38,8)").alias("volume"),
        F.max("target").alias("target"),
    )


def day_states(tx: DataFrame, period: str = "day") -> DataFrame:
    """One row for each user and day with completed exchanges; rows without an instant belong to no day and are left out."""
    done = lifecycle.successful(tx).dropna(subset=["transaction_timestamp"])
    at = F.col("transaction_timestamp")
    day = at.cast("date") if period == "day" else F.trunc(at.cast("date"), period)
    return done.groupBy("user_id", day.alias("day")).agg(
        F.min(at).alias("first_at"),
        F.max(at).alias("last_at"),
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("transaction_amount_krw").cast("decimal(28,8)")).cast("decimal(38,8)").alias("volume"),
        any_flag(F.col("order_type") == lifecycle.TARGET_RATE_ORDER).alias("target"),
    )


def _folders(spark: SparkSession, path: str, name: str, whole: bool = False) -> list[str]:
    """The days in the names ``name=day`` below a folder, in order; ``whole``: only those whose writing came to its end."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    top = hadoop(path)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath() for f in files.listStatus(top)] if files.exists(top) else []
    if whole:
        found = [p for p in found if files.exists(hadoop(p, "_SUCCESS"))]
    return sorted(m.group(1) for p in found if (m := re.fullmatch(name + r"=(\d{4}-\d\d-\d\d)", p.getName())))


def _versions(spark: SparkSession, store: str) -> list[str]:
    """The days up to which totals are complete."""
    return _folders(spark, f"{store}/totals", "upto", whole=True)


def _drop(spark: SparkSession, path: str) -> None:
    gone = spark._jvm.org.apache.hadoop.fs.Path(path)
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def stored_days(spark: SparkSession, store: str, days: list[str]) -> DataFrame:
    """States of the named days; no other folder is listed or read."""
    paths = [f"{store}/days/day={d}" for d in days]
    return spark.read.schema(_DAY).option("basePath", f"{store}/days").parquet(*paths)


def add_days(store: str, tx: DataFrame, period: str = "day") -> None:
    """Store the days that ``tx`` covers and bring the totals up to date.

    ``tx`` holds whole days: what was stored for a day is replaced.  Totals that held an earlier form of such a day are
    dropped before the days are written, so a run that breaks off leaves nothing wrong behind and is simply run again.
    An empty ``tx`` changes nothing.  ``period`` week, month, quarter or year keeps fewer and larger folders, named by
    their first day; an increment then holds whole periods, and a store keeps to one.  Runs jobs at once.
    """
    spark = tx.sparkSession
    fresh = staged(day_states(tx, period), "mart-days")
    days = sorted(r[0] for r in fresh.select(F.col("day").cast("string")).distinct().collect())
    if not days:
        return
    versions = _versions(spark, store)
    for stale in [v for v in versions if v >= days[0]]:
        _drop(spark, f"{store}/totals/upto={stale}")
    writer = fresh.repartition("day").write.partitionBy("day").mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").parquet(f"{store}/days")
    base = max((v for v in versions if v < days[0]), default="")
    states, since = fresh.drop("day"), [d for d in _folders(spark, f"{store}/days", "day") if d > base and d not in set(days)]
    if since:
        states = states.unionByName(stored_days(spark, store, since).drop("day"))
    if base:
        states = states.unionByName(spark.read.schema(_STATE).parquet(f"{store}/totals/upto={base}"))
    upto = max([*days, *since])
    _merged(states).write.mode("overwrite").parquet(f"{store}/totals/upto={upto}")


def success_summary(spark: SparkSession, store: str) -> DataFrame:
    """``lifecycle.success_summary`` of all stored days, from the newest totals."""
    versions = _versions(spark, store)
    empty = spark.createDataFrame([], _STATE)
    totals = spark.read.schema(_STATE).parquet(f"{store}/totals/upto={versions[-1]}") if versions else empty
    return totals.select(
        "user_id",
        F.col("first_at").alias("first_successful_transaction_at"),
        F.col("last_at").alias("last_successful_transaction_at"),
        F.col("n").alias("successful_transaction_count"),
        F.col("volume").cast("double").alias("successful_transaction_volume"),
        F.col("target").alias("target_rate_user_flag"),
    )


def user_lifecycle(store: str, users: DataFrame, events: DataFrame, activation_days: int = 14) -> DataFrame:
    """The user lifecycle mart with its transactions' part taken from the store."""
    flagged = lifecycle.event_flag(events, lifecycle.RATE_ALERT_EVENT, "rate_alert_user_flag")
    summary = success_summary(users.sparkSession, store)
    joined = users.join(summary, "user_id", "left").join(flagged, "user_id", "left")
    return lifecycle.lifecycle_columns(joined, activation_days)

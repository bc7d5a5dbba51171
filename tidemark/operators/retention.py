"""Cohort retention by months since the first completed exchange."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.numeric import pct
from tidemark.functions.temporal import month_start, months_between_starts
from tidemark.operators.lifecycle import successful, valid_users

OFFSET = "months_since_first_transaction"


def user_months(tx: DataFrame) -> DataFrame:
    """Distinct (user, month) of completed exchanges; a busy user collapses to one row per month."""
    month = month_start("transaction_timestamp").alias("activity_month")
    return successful(tx).select("user_id", month).distinct()


def cohort_retention(tx: DataFrame, mart: DataFrame | None = None, max_month: int | None = None) -> DataFrame:
    """Users of each cohort active again ``m`` months later.

    With ``mart`` only validly onboarded users count; with ``max_month`` offsets stop there.  The months are
    de-duplicated first, so the counts are plain counts, and a user's cohort is the first of the (calendar
    bounded) month rows.  Cohort size is the count at offset 0, which every member reaches by definition.
    """
    months = user_months(tx)
    if mart is not None:
        months = months.join(valid_users(mart).select("user_id"), "user_id", "left_semi")
    cohort = F.min("activity_month").over(W.partitionBy("user_id"))
    placed = months.withColumn("cohort_month", cohort).withColumn(
        OFFSET, months_between_starts("cohort_month", "activity_month")
    )
    counts = placed.groupBy("cohort_month", OFFSET).agg(F.count(F.lit(1)).alias("retained_users"))
    size = F.max(F.when(F.col(OFFSET) == 0, F.col("retained_users"))).over(W.partitionBy("cohort_month"))
    rated = counts.withColumn("cohort_users", size)
    if max_month is not None:
        rated = rated.where(F.col(OFFSET).between(0, max_month))
    return rated.select(
        "cohort_month",
        OFFSET,
        "cohort_users",
        "retained_users",
        pct("retained_users", "cohort_users").alias("retention_rate"),
    ).orderBy("cohort_month", OFFSET)


def weighted_retention(cohorts: DataFrame) -> DataFrame:
    """Retention per offset over all cohorts, weighted by cohort size."""
    return (
        cohorts.groupBy(OFFSET)
        .agg(
            F.sum("retained_users").alias("retained_users"),
            F.sum("cohort_users").alias("cohort_users"),
            pct(F.sum("retained_users"), F.sum("cohort_users")).alias("weighted_retention_rate"),
        )
        .orderBy(OFFSET)
    )


def cohort_matrix(
    cohorts: DataFrame, low: int = 1, high: int = 6, tail: int | None = 12, prefix: str = "m"
) -> DataFrame:
    """Cohorts down, month offsets across; ``tail`` keeps the newest cohorts of the report."""
    offsets: Sequence[int] = range(low, high + 1)
    wide = (
        cohorts.where(F.col(OFFSET).between(low, high))
        .groupBy("cohort_month")
        .pivot(OFFSET, list(offsets))
        .agg(F.first("retention_rate"))
    )
    wide = wide.withColumnsRenamed({str(i): f"{prefix}{i}" for i in offsets})
    newest = wide.orderBy(F.desc("cohort_month"))
    return (newest.limit(tail) if tail is not None else newest).orderBy("cohort_month")

"""Monthly user snapshots: trailing features and the following window's target."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.numeric import count_where, exact_avg, exact_sum, pct, ratio, round_half_up
from tidemark.functions.temporal import month_key
from tidemark.operators.lifecycle import COMPLETED, exchanges, successful

SNAPSHOT_COLUMNS = (
    "user_id",
    "observation_date",
    "recency_days",
    "transactions_90d",
    "transactions_all",
    "total_volume_90d",
    "failed_ratio_90d",
    "target_repeat_30d",
)
REPEAT_FEATURES = ("recency_days", "transactions_90d", "total_volume_90d", "failed_ratio_90d")
TARGET = "target_repeat_30d"


def last_complete_month_end(tx: DataFrame, horizon: int = 30) -> date | None:
    """Last month end whose target window the data covers.  One MAX over one column."""
    last = F.max(F.col("transaction_timestamp").cast("date"))
    seen = F.date_add(last, -horizon)
    month_end = F.when(F.last_day(seen) == seen, seen).otherwise(F.last_day(F.add_months(seen, -1)))
    return successful(tx).agg(month_end.alias("d")).head()["d"]


def build_snapshots(tx: DataFrame, last: date, window: int = 90, horizon: int = 30) -> DataFrame:
    """One row per user and month end from the month of the first completed exchange to ``last``.

    Each attempt is sent to the few month ends whose trailing window or target window covers it, and
    counted there with map-side combining; users are never crossed with dates.  The rows so made are at most
    one per user and calendar month, and the empty months between them are filled by expanding the gap to
    the next row, so running totals and filling share one per-user window.
    """
    day = F.col("transaction_timestamp").cast("date")
    done = F.col("transaction_status") == COMPLETED
    base = exchanges(tx).select("user_id", day.alias("day"), done.alias("done"), "transaction_amount_krw")
    first_month = F.trunc(F.date_add("day", -horizon), "MM")
    last_month = F.trunc(F.date_add("day", window - 1), "MM")
    months = F.explode(F.sequence(first_month, last_month, F.expr("INTERVAL 1 MONTH")))
    spread = base.withColumn("month", months).withColumn("observation_date", F.last_day("month"))
    age = F.date_diff("observation_date", "day")
    spread = spread.withColumn("age", age).where(
        (F.col("age") >= -horizon)
        & ((F.col("age") < window) | (F.col("month") == F.trunc("day", "MM")))
    )
    trailing = (F.col("age") >= 0) & (F.col("age") < window)
    own_month = F.col("done") & (F.col("month") == F.trunc("day", "MM"))
    stats = spread.groupBy("user_id", "observation_date").agg(
        count_where(trailing & F.col("done")).alias("n_done"),
        count_where(trailing & ~F.col("done")).alias("n_failed"),
        exact_sum(F.when(trailing & F.col("done"), F.col("transaction_amount_krw"))).alias("volume"),
        F.max(F.when((F.col("age") < 0) & F.col("done"), 1).otherwise(0)).alias("target"),
        count_where(own_month).alias("month_done"),
        F.max(F.when(own_month, F.col("day"))).alias("month_last"),
    )
    by_user = W.partitionBy("user_id").orderBy("observation_date")
    upto = by_user.rowsBetween(W.unboundedPreceding, W.currentRow)
    running = stats.withColumns(
        {
            "transactions_all": F.sum("month_done").over(upto),
            "last_done": F.max("month_last").over(upto),
            "next_end": F.lead("observation_date").over(by_user),
        }
    ).where((F.col("transactions_all") > 0) & (F.col("observation_date") <= F.lit(last)))
    until = F.least(F.coalesce(F.last_day(F.add_months("next_end", -1)), F.lit(last)), F.lit(last))
    months = F.sequence(F.trunc("observation_date", "MM"), F.trunc(until, "MM"), F.expr("INTERVAL 1 MONTH"))
    filled = running.withColumn("month", F.explode(months)).withColumn("filled", F.last_day("month"))

    def here(c: Column, empty) -> Column:
        return F.when(F.col("filled") == F.col("observation_date"), F.coalesce(c, F.lit(empty))).otherwise(
            F.lit(empty)
        )

    failed = ratio("n_failed", F.col("n_failed") + F.col("n_done"))
    return filled.select(
        "user_id",
        F.col("filled").alias("observation_date"),
        F.date_diff("filled", "last_done").alias("recency_days"),
        here(F.col("n_done"), 0).cast("long").alias("transactions_90d"),
        F.col("transactions_all").cast("long").alias("transactions_all"),
        here(F.col("volume"), 0.0).alias("total_volume_90d"),
        here(failed, 0.0).alias("failed_ratio_90d"),
        here(F.col("target"), 0).cast("int").alias(TARGET),
    )


def snapshot_features(snapshots: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The modelling projection."""
    return snapshots.select(*(columns or [c for c in SNAPSHOT_COLUMNS if c != "transactions_all"]))


def snapshot_profile(snapshots: DataFrame) -> DataFrame:
    """One-row check of the modelling table."""
    rows = F.count(F.lit(1))
    return snapshots.agg(
        rows.alias("snapshot_rows"),
        F.countDistinct("user_id").alias("users"),
        F.min("observation_date").alias("min_observation_date"),
        F.max("observation_date").alias("max_observation_date"),
        F.sum(TARGET).alias("positive_targets"),
        pct(F.sum(TARGET), rows).alias("positive_target_rate"),
        round_half_up(F.avg("recency_days"), 2).alias("avg_recency_days"),
        round_half_up(F.avg("transactions_90d"), 2).alias("avg_transactions_90d"),
        round_half_up(exact_avg("failed_ratio_90d"), 4).alias("avg_failed_ratio_90d"),
    )


def monthly_profile(snapshots: DataFrame) -> DataFrame:
    """Rows, users and positive rate per observation month."""
    return (
        snapshots.groupBy(month_key("observation_date").alias("observation_month"))
        .agg(
            F.count("user_id").alias("rows"),
            F.countDistinct("user_id").alias("users"),
            F.avg(TARGET).alias("positive_rate"),
        )
        .orderBy("observation_month")
    )


def latest(df: DataFrame, date_col: str = "observation_date") -> DataFrame:
    """Rows of the newest period; the newest date is a scalar sub-query that reads one column."""
    newest = df.agg(F.max(date_col).alias("newest"))
    return df.where(F.col(date_col) == newest.scalar())

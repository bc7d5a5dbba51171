"""Exchange behaviour by market regime."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.labels import order_rank
from tidemark.functions.numeric import count_where, exact_avg, exact_sum, pct, ratio, round_half_up
from tidemark.operators.lifecycle import COMPLETED, FAILED, exchanges

# Fixed regime names, in order.
REGIME_ORDER = ("low", "normal", "high")
REGIME = "market_regime_at_transaction"


def sort_by_rank(df: DataFrame, column: str, order: Sequence[str], *more) -> DataFrame:
    return df.orderBy(order_rank(column, order), *more)


def regime_behavior(tx: DataFrame) -> DataFrame:
    """Attempts, successes, success rate, mean amount and completed volume per regime."""
    done = F.col("transaction_status") == COMPLETED
    amount = F.col("transaction_amount_krw")
    grouped = (
        exchanges(tx)
        .groupBy(REGIME)
        .agg(
            F.count(F.lit(1)).alias("transaction_attempts"),
            count_where(done).alias("successful_transactions"),
            pct(count_where(done), F.count(F.lit(1))).alias("success_rate"),
            round_half_up(exact_avg(amount), 0).alias("avg_transaction_amount_krw"),
            round_half_up(exact_sum(F.when(done, amount).otherwise(0.0)), 0).alias("completed_volume_krw"),
        )
    )
    return sort_by_rank(grouped, REGIME, REGIME_ORDER)


def regime_activity(tx: DataFrame, rates: DataFrame) -> DataFrame:
    """Attempts and successes per hour spent in the regime; both sides shrink to one row per regime first."""
    hours = rates.groupBy("market_regime").agg(F.count(F.lit(1)).alias("regime_hour_rows"))
    activity = (
        exchanges(tx)
        .groupBy(F.col(REGIME).alias("market_regime"))
        .agg(
            F.count(F.lit(1)).alias("transaction_attempts"),
            count_where(F.col("transaction_status") == COMPLETED).alias("successful_transactions"),
        )
    )
    per_hour = activity.join(hours, "market_regime").select(
        "market_regime",
        "regime_hour_rows",
        "transaction_attempts",
        "successful_transactions",
        ratio("transaction_attempts", "regime_hour_rows", 2).alias("attempts_per_regime_hour"),
        ratio("successful_transactions", "regime_hour_rows", 2).alias("successful_transactions_per_regime_hour"),
    )
    return sort_by_rank(per_hour, "market_regime", REGIME_ORDER)


def share_within(df: DataFrame, part: Sequence[str], key: Sequence[str], count: str, share: str) -> DataFrame:
    """Row counts per (part, key) and their share of the part; the window runs over aggregated rows."""
    counts = df.groupBy(*part, *key).agg(F.count(F.lit(1)).alias(count))
    return counts.withColumn(share, pct(count, F.sum(count).over(W.partitionBy(*part))))


def failure_share(tx: DataFrame) -> DataFrame:
    """Failure reasons inside each regime."""
    failed = exchanges(tx).where(F.col("transaction_status") == FAILED)
    shares = share_within(failed, [REGIME], ["failure_reason"], "failed_transactions", "share_within_regime")
    return sort_by_rank(shares, REGIME, REGIME_ORDER, F.desc("failed_transactions"), F.col("failure_reason"))


def regime_overview(activity: DataFrame, behavior: DataFrame) -> DataFrame:
    """Regime activity with the success rate beside it."""
    rate = behavior.select(F.col(REGIME).alias("market_regime"), "success_rate")
    return sort_by_rank(activity.join(rate, "market_regime", "left"), "market_regime", REGIME_ORDER)

"""First success, repeat-within-N-days and the rates built on it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.labels import first_match, order_rank
from tidemark.functions.numeric import pct, round_half_up
from tidemark.functions.temporal import days, whole_second
from tidemark.operators.lifecycle import successful, valid_users

# Fixed labels: comparison -> (flag column, label of 1, label of 0).
FEATURE_COMPARISONS = {
    "Target-rate adoption": ("target_rate_user_flag", "Target-rate users", "Manual-only users"),
    "Rate-alert adoption": ("rate_alert_user_flag", "Rate-alert users", "Non-rate-alert users"),
}
# Fixed labels of the 2 x 2 feature combination.
FEATURE_COMBINATIONS = (
    ("target_rate_user_flag = 1 AND rate_alert_user_flag = 1", "Both target-rate and rate-alert"),
    ("target_rate_user_flag = 1 AND rate_alert_user_flag = 0", "Target-rate only"),
    ("target_rate_user_flag = 0 AND rate_alert_user_flag = 1", "Rate-alert only"),
)
NO_FEATURE = "Neither feature"
# Fixed labels of the support groups, in report order.
SUPPORT_GROUPS = ("No support ticket", "One support ticket", "Multiple support tickets")


def first_time(tx: DataFrame) -> DataFrame:
    """First completed exchange per user."""
    return successful(tx).groupBy("user_id").agg(F.min("transaction_timestamp").alias("first_transaction_at"))


def repeat_within(tx: DataFrame, days_after: int = 30, censor_after=None) -> DataFrame:
    """Per user with a completed exchange: is there another strictly later and within ``days_after``?

    Only a user's first two distinct instants can decide that, so there is no self-join: instants are made
    distinct (copies collapse on the map side), and the two earliest per user are kept before the second
    shuffle by the row-number limit.  With ``censor_after`` users whose window ends later get NULL.
    """
    instants = successful(tx).select("user_id", whole_second("transaction_timestamp").alias("at")).distinct()
    order = F.row_number().over(W.partitionBy("user_id").orderBy(F.col("at").asc_nulls_last()))
    two = instants.withColumn("nth", order).where("nth <= 2")
    pair = two.groupBy("user_id").agg(
        F.min("at").alias("first_transaction_at"),
        F.max(F.when(F.col("nth") == 2, F.col("at"))).alias("second_transaction_at"),
    )
    limit = F.col("first_transaction_at") + days(days_after)
    flag = F.when(F.col("second_transaction_at") <= limit, 1).otherwise(0)
    if censor_after is not None:
        flag = F.when(limit <= F.lit(censor_after), flag)
    return pair.select("user_id", "first_transaction_at", flag.alias("d30_repeat_flag"))


def first_exchange_users(mart: DataFrame, repeat: DataFrame) -> DataFrame:
    """Valid users with a first exchange, with their repeat flag; one row per user on both sides."""
    reached = valid_users(mart).where(F.col("first_successful_transaction_at").isNotNull())
    return reached.join(repeat.select("user_id", "d30_repeat_flag"), "user_id")


def _rate_columns() -> list[Column]:
    flag = F.col("d30_repeat_flag")
    return [
        F.count(F.lit(1)).alias("first_exchange_users"),
        F.sum(flag).alias("d30_repeat_users"),
        pct(F.sum(flag), F.count(F.lit(1))).alias("d30_repeat_rate"),
    ]


def repeat_rate(mart: DataFrame, repeat: DataFrame, by: Sequence[str] = ("acquisition_channel",)) -> DataFrame:
    """Repeat rate per group, best group first."""
    grouped = first_exchange_users(mart, repeat).groupBy(*by).agg(*_rate_columns())
    return grouped.orderBy(F.desc("d30_repeat_rate"), *by)


def overall_rate(df: DataFrame, numerator: str, denominator: str, name: str, digits: int = 2) -> DataFrame:
    """Ratio of sums over already grouped rows, in percent."""
    return df.agg(pct(F.sum(numerator), F.sum(denominator), digits).alias(name))


def feature_retention(
    mart: DataFrame, repeat: DataFrame, comparisons: Mapping[str, tuple[str, str, str]] = FEATURE_COMPARISONS
) -> DataFrame:
    """Users with a feature against users without it, for several features in one pass."""
    labelled = [
        F.struct(
            F.lit(kind).alias("comparison_type"),
            F.when(F.col(flag) == 1, F.lit(yes)).otherwise(F.lit(no)).alias("user_group"),
        )
        for kind, (flag, yes, no) in comparisons.items()
    ]
    base = first_exchange_users(mart, repeat)
    rows = base.select("d30_repeat_flag", F.inline(F.array(*labelled)))
    return (
        rows.groupBy("comparison_type", "user_group")
        .agg(*_rate_columns())
        .orderBy("comparison_type", F.desc("d30_repeat_rate"))
    )


def feature_combo(mart: DataFrame, repeat: DataFrame) -> DataFrame:
    """Repeat rate of the four combinations of two features."""
    label = first_match(FEATURE_COMBINATIONS, NO_FEATURE)
    base = first_exchange_users(mart, repeat).withColumn("feature_group", label)
    return base.groupBy("feature_group").agg(*_rate_columns()).orderBy(F.desc("d30_repeat_rate"), "feature_group")


def ticket_summary(tickets: DataFrame) -> DataFrame:
    return tickets.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("ticket_count"),
        F.avg("resolution_time_hours").alias("avg_resolution_time_hours"),
        F.avg("satisfaction_score").alias("avg_satisfaction_score"),
    )


def support_impact(mart: DataFrame, repeat: DataFrame, tickets: DataFrame) -> DataFrame:
    """Repeat rate and service quality by number of support tickets."""
    none, one, many = SUPPORT_GROUPS
    group = first_match([("ticket_count IS NULL", none), ("ticket_count = 1", one)], many)
    base = first_exchange_users(mart, repeat).join(ticket_summary(tickets), "user_id", "left")
    return (
        base.withColumn("support_group", group)
        .groupBy("support_group")
        .agg(
            *_rate_columns(),
            round_half_up(F.avg("avg_resolution_time_hours"), 2).alias("avg_resolution_time_hours"),
            round_half_up(F.avg("avg_satisfaction_score"), 2).alias("avg_satisfaction_score"),
        )
        .orderBy(order_rank("support_group", SUPPORT_GROUPS))
    )


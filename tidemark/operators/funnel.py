"""Onboarding funnel: wide, by dimension, as stage rows, and over time."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.numeric import count_where, pct, ratio, round_half_up
from tidemark.functions.temporal import month_key
from tidemark.operators.lifecycle import valid_users


@dataclass(frozen=True)
class Stage:
    """A funnel step: output column, SQL test of having reached it, rate column and display label."""

    name: str
    reached: str
    rate: str
    label: str


# Fixed stage names, rate names and labels.
ENTRY = Stage("valid_signups", "true", "signup_rate", "Valid signup")
STAGES = (
    Stage("kyc_completed", "kyc_completed_at IS NOT NULL", "kyc_completion_rate", "KYC completed"),
    Stage("bank_linked", "bank_account_linked_at IS NOT NULL", "bank_link_rate", "Bank linked"),
    Stage(
        "first_successful_exchange",
        "first_successful_transaction_at IS NOT NULL",
        "first_exchange_rate",
        "First successful exchange",
    ),
    Stage("activated_within_14_days", "activation_flag = 1", "activation_rate_14d", "Activated within 14 days"),
)


def funnel(
    mart: DataFrame,
    stages: Sequence[Stage] = STAGES,
    by: Sequence[str] = (),
    rates: Sequence[str] | None = None,
) -> DataFrame:
    """Users reaching each stage, over valid users, in one aggregation.

    ``rates`` names the rate columns to add; by default none without ``by`` and all with it.
    """
    wanted = ([s.rate for s in stages] if by else []) if rates is None else rates
    entered = F.count(F.lit(1))
    columns = [entered.alias(ENTRY.name)]
    for stage in stages:
        reached = count_where(F.expr(stage.reached))
        columns.append(reached.alias(stage.name))
        if stage.rate in wanted:
            columns.append(pct(reached, entered).alias(stage.rate))
    counted = valid_users(mart).groupBy(*by).agg(*columns)
    last = stages[-1].rate
    return counted.orderBy(F.desc(last), *by) if by and last in wanted else counted


def funnel_long(wide: DataFrame, stages: Sequence[Stage] = STAGES, by: Sequence[str] = ()) -> DataFrame:
    """Stage rows ``(stage_no, stage, users)`` from the wide funnel."""
    steps = [
        F.struct(F.lit(i).alias("stage_no"), F.lit(s.label).alias("stage"), F.col(s.name).alias("users"))
        for i, s in enumerate((ENTRY, *stages), start=1)
    ]
    return wide.select(*by, F.inline(F.array(*steps)))


def stage_rate(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Conversion from the first stage, in percent.  A handful of stage rows per group."""
    start = F.max(F.when(F.col("stage_no") == 1, F.col("users"))).over(W.partitionBy(*by))
    return long.withColumn("conversion_from_start", pct("users", start))


def prev_step_rate(long: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Conversion from the stage before, in percent; NULL on the first stage."""
    previous = F.lag("users").over(W.partitionBy(*by).orderBy("stage_no"))
    return long.withColumn("conversion_from_previous", pct("users", previous))


def monthly_trend(mart: DataFrame) -> DataFrame:
    """Signups and activation by signup month."""
    month = mart.withColumn("signup_month", month_key("signup_timestamp"))
    stages = [s for s in STAGES if s.name != "bank_linked"]
    return funnel(month, stages, by=["signup_month"], rates=["activation_rate_14d"]).orderBy("signup_month")


def lifecycle_summary(mart: DataFrame) -> DataFrame:
    """One row of headline numbers over valid users."""
    valid, active = F.sum("onboarding_valid_flag"), F.sum("activation_flag")
    return valid_users(mart).agg(
        F.count(F.lit(1)).alias("users"),
        valid.alias("valid_onboarding_users"),
        active.alias("activated_within_14_days"),
        pct(active, valid).alias("activation_rate_14d"),
        round_half_up(F.avg("activation_days_exact"), 2).alias("avg_activation_days"),
        F.sum("target_rate_user_flag").alias("target_rate_users"),
        F.sum("rate_alert_user_flag").alias("rate_alert_users"),
    )


# Fixed feature names, in report order.
FEATURE_FLAGS = {"rate_alert": "rate_alert_user_flag", "target_rate_order": "target_rate_user_flag"}


def feature_adoption(mart: DataFrame, flags: dict[str, str] = FEATURE_FLAGS) -> DataFrame:
    """Adopters and adoption rate per feature: one scan, then one row per feature."""
    sums = [F.sum(flag).alias(name) for name, flag in flags.items()]
    total = valid_users(mart).agg(F.count(F.lit(1)).alias("eligible_users"), *sums)
    rows = [F.struct(F.lit(n).alias("feature"), F.col(n).alias("adopted_users")) for n in flags]
    long = total.select("eligible_users", F.inline(F.array(*rows)))
    return long.select(
        "feature", "adopted_users", "eligible_users", pct("adopted_users", "eligible_users").alias("adoption_rate")
    )


def channel_quality(channel_funnel: DataFrame, channel_repeat: DataFrame) -> DataFrame:
    """Channel funnel with its repeat rate; both inputs hold one row per channel."""
    joined = channel_funnel.join(channel_repeat, "acquisition_channel", "left")
    return joined.orderBy(F.desc("activation_rate_14d"), F.desc("d30_repeat_rate"))


def activation_ratio(wide: DataFrame) -> DataFrame:
    """Activated over valid signups of the wide funnel, unrounded."""
    return wide.select(ratio("activated_within_14_days", "valid_signups").alias("activation_share"))

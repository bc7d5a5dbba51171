"""Turning scores into segments and actions: two rule sets over scores, snapshot features and user context."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.labels import bin_left, bin_right, first_match, map_with_default
from tidemark.functions.numeric import exact_avg, exact_sum, round_half_up
from tidemark.operators.joins import checked_join
from tidemark.operators.ranking import exact_quantiles
from tidemark.plans.staging import staged

FEE_RATE = 0.00025

# Fixed probability segments.
PROBABILITY_LABELS = ("Low repeat probability", "Medium repeat probability", "High repeat probability")
PROBABILITY_EDGES_A = (-0.01, 0.35, 0.70, 1.00)
PROBABILITY_EDGES_B = (0.35, 0.70)

# Fixed rule set A: condition, risk segment, action, reason; the first true condition wins.
RULES_A = (
    (
        "value_segment = 'High value' AND repeat_probability < 0.50",
        "High-value at-risk users",
        "Prioritize service recovery",
        "High recent value but below-median repeat likelihood.",
    ),
    (
        "transactions_90d = 0",
        "No recent transaction users",
        "Send reactivation education",
        "No transaction in the 90-day observation window.",
    ),
    (
        "failed_ratio_90d >= 0.20",
        "High failed transaction users",
        "Resolve transaction friction",
        "At least 20% of recent transaction attempts failed.",
    ),
    (
        "repeat_probability < 0.35",
        "Low repeat probability users",
        "Test feature onboarding prompt",
        "Low repeat likelihood and suitable for a controlled test.",
    ),
)
DEFAULT_ACTION_A = "Maintain engagement"
DEFAULT_REASON_A = "No immediate risk rule was triggered."

# Fixed rule set B, risk segments.
RISK_RULES_B = (
    ("value_segment = 'High value' AND repeat_probability < 0.50", "High-value at-risk users"),
    ("transactions_90d = 0", "No recent transaction users"),
    ("failed_ratio_90d >= 0.15", "High failed-ratio users"),
    ("repeat_probability < 0.35", "Low repeat probability users"),
    ("repeat_probability < 0.70", "Medium repeat probability users"),
)
DEFAULT_RISK_B = "High repeat probability users"
# Fixed rule set B, actions and reasons.
ACTION_RULES_B = (
    (
        "value_segment = 'High value' AND repeat_probability < 0.50",
        "Priority retention outreach",
        "High recent volume but repeat probability is below 50%.",
    ),
    (
        "failed_ratio_90d >= 0.15",
        "Reliability support message",
        "Recent failed transaction ratio is elevated.",
    ),
    (
        "repeat_probability < 0.35 AND transactions_90d = 0",
        "Reactivation education campaign",
        "Low repeat probability and no transaction activity in the last 90 days.",
    ),
    (
        "repeat_probability < 0.35",
        "Reactivation offer",
        "Low repeat probability despite some historical product activity.",
    ),
    (
        "repeat_probability < 0.70 AND target_rate_user_flag = 0 AND rate_alert_user_flag = 0",
        "Rate-alert prompt",
        "Medium repeat probability and no target-rate or rate-alert adoption yet.",
    ),
    (
        "repeat_probability < 0.70 AND rate_alert_user_flag = 0",
        "Promote rate-alert adoption",
        "Medium repeat probability and rate-alert feature has not been adopted.",
    ),
    (
        "repeat_probability >= 0.70 AND target_rate_user_flag = 0",
        "Target-rate upsell",
        "High repeat probability and target-rate feature has not been adopted.",
    ),
)
DEFAULT_ACTION_B = "Maintain engagement"
DEFAULT_REASON_B = "User already has strong repeat probability or feature engagement."

# Fixed output order.
TARGETING_COLUMNS = (
    "user_id",
    "observation_date",
    "target_repeat_30d",
    "repeat_probability",
    "predicted_repeat_30d",
    "probability_segment",
    "risk_segment",
    "recommended_action",
    "recommendation_reason",
    "recency_days",
    "transactions_90d",
    "transactions_all",
    "total_volume_90d",
    "estimated_fee_proxy_90d",
    "failed_ratio_90d",
    "value_segment",
    "acquisition_channel",
    "successful_transaction_count",
    "successful_transaction_volume",
    "target_rate_user_flag",
    "rate_alert_user_flag",
)

# Fixed readiness actions per regime.
READINESS_ACTIONS = {
    "low": "Normal monitoring; use calmer periods for product education.",
    "normal": "Maintain standard staffing and transaction monitoring.",
    "high": "Prepare support coverage, rate-change messaging, and tighter transaction monitoring.",
}


def fee_proxy(volume: str | Column = "total_volume_90d", rate: float = FEE_RATE) -> Column:
    """Volume times a fee rate, 0 without volume."""
    v = F.col(volume) if isinstance(volume, str) else volume
    return F.coalesce(v, F.lit(0.0)) * F.lit(rate)


def high_value_threshold(df: DataFrame, column: str = "total_volume_90d", positive_only: bool = True) -> float | None:
    """75th percentile of recent volume, over the active users or over all of them."""
    base = df.where(F.col(column) > 0) if positive_only else df
    return exact_quantiles(base, column, [0.75])[0]


def value_segment(threshold: float | None, labels: str = "A", column: str = "total_volume_90d") -> Column:
    """Two labels (A) or three (B, which sets inactive users apart)."""
    above = F.col(column) >= F.lit(threshold).cast("double")
    if labels == "A":
        return F.when(above, "High value").otherwise("Standard value")
    return first_match([(above, "High value"), (F.col(column) > 0, "Active value")], "No recent value")


def _with_context(scores: DataFrame, snapshots: DataFrame, context: DataFrame) -> DataFrame:
    features = snapshots.select(
        "user_id",
        "observation_date",
        "recency_days",
        "transactions_90d",
        "transactions_all",
        "total_volume_90d",
        "failed_ratio_90d",
    )
    scored = checked_join(scores, features, ["user_id", "observation_date"], "one_to_one")
    return checked_join(scored, context, ["user_id"], "many_to_one")


def targeting(
    scores: DataFrame,
    snapshots: DataFrame,
    context: DataFrame,
    rules: str = "A",
    threshold: float | None = None,
) -> DataFrame:
    """Scores with segments, action and reason.

    ``scores``: user_id, observation_date, target_repeat_30d, repeat_probability, predicted_repeat_30d.
    Every rule is an SQL condition, so all labels are CASE expressions in the same stage as the joins.
    Without ``threshold`` the high-value cut is computed from the scored rows.  Rules A keep only scores that have a
    snapshot with the same user, date and target; rules B keep all.  The joined rows are written once, as both the
    cut and the result read them; this runs jobs at once.
    """
    if rules == "A":
        keys = ["user_id", "observation_date", "target_repeat_30d"]
        scores = scores.join(snapshots.select(*keys), keys, "left_semi")
    base = staged(_with_context(scores, snapshots, context), "targeting")
    if threshold is None:
        threshold = high_value_threshold(base, positive_only=rules == "A")
    base = base.withColumn("value_segment", value_segment(threshold, rules))
    if rules == "A":
        segment = bin_right("repeat_probability", PROBABILITY_EDGES_A, PROBABILITY_LABELS)
        base = base.withColumn("probability_segment", segment)
        risk = first_match(((c, r) for c, r, _, _ in RULES_A), F.concat("probability_segment", F.lit(" users")))
        action = first_match(((c, a) for c, _, a, _ in RULES_A), DEFAULT_ACTION_A)
        reason = first_match(((c, w) for c, _, _, w in RULES_A), DEFAULT_REASON_A)
    else:
        segment = bin_left("repeat_probability", PROBABILITY_EDGES_B, PROBABILITY_LABELS)
        base = base.withColumn("probability_segment", segment)
        risk = first_match(RISK_RULES_B, DEFAULT_RISK_B)
        action = first_match(((c, a) for c, a, _ in ACTION_RULES_B), DEFAULT_ACTION_B)
        reason = first_match(((c, w) for c, _, w in ACTION_RULES_B), DEFAULT_REASON_B)
    out = base.withColumns(
        {
            "risk_segment": risk,
            "recommended_action": action,
            "recommendation_reason": reason,
            "estimated_fee_proxy_90d": fee_proxy(),
        }
    )
    return ordered(out, TARGETING_COLUMNS)


def ordered(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def targeting_summary(df: DataFrame) -> DataFrame:
    """Users and mean score per segment and action, largest first."""
    keys = ["risk_segment", "recommended_action"]
    return (
        df.groupBy(*keys)
        .agg(
            F.count("user_id").alias("users"),
            round_half_up(exact_avg("repeat_probability"), 10).alias("average_repeat_probability"),
        )
        .orderBy(F.desc("users"), *keys)
    )


def audience_summary(df: DataFrame) -> DataFrame:
    """Users, mean score and recent volume per segment, largest first."""
    return (
        df.groupBy("risk_segment")
        .agg(
            F.count("user_id").alias("users"),
            round_half_up(exact_avg("repeat_probability"), 10).alias("average_repeat_probability"),
            exact_sum("total_volume_90d").alias("recent_volume_krw"),
        )
        .orderBy(F.desc("users"), "risk_segment")
    )


def campaign_audience(df: DataFrame) -> DataFrame:
    """Everyone but the users already likely to repeat."""
    return df.where(F.col("risk_segment") != DEFAULT_RISK_B)


def priority_audience(df: DataFrame) -> DataFrame:
    return campaign_audience(df).agg(F.count(F.lit(1)).alias("priority_audience"))


def readiness(df: DataFrame, regime: str = "predicted_regime", default: str | None = None) -> DataFrame:
    return df.withColumn("recommended_action", map_with_default(regime, READINESS_ACTIONS, default))


def latest_signal(df: DataFrame, date_col: str = "date") -> DataFrame:
    """The newest prediction row."""
    return df.orderBy(F.desc(date_col)).limit(1)

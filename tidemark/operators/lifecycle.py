"""The user lifecycle mart and the per-user summaries it is joined from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import any_flag, exact_sum, round_half_up
from tidemark.functions.temporal import elapsed, within_days

# Fixed values of the data model.
EXCHANGE = "exchange"
COMPLETED = "completed"
FAILED = "failed"
TARGET_RATE_ORDER = "target_rate"
RATE_ALERT_EVENT = "rate_alert_created"

MART_COLUMNS = (
    "user_id",
    "signup_timestamp",
    "acquisition_channel",
    "kyc_completed_at",
    "bank_account_linked_at",
    "first_successful_transaction_at",
    "last_successful_transaction_at",
    "days_to_kyc",
    "activation_days_exact",
    "activation_hours",
    "successful_transaction_count",
    "successful_transaction_volume",
    "target_rate_user_flag",
    "rate_alert_user_flag",
    "onboarding_valid_flag",
    "activation_flag",
)


def exchanges(tx: DataFrame) -> DataFrame:
    """Exchange attempts of any status."""
    return tx.where(F.col("transaction_type") == EXCHANGE)


def successful(tx: DataFrame) -> DataFrame:
    """Completed exchanges; both tests reach the Parquet scan."""
    return tx.where((F.col("transaction_type") == EXCHANGE) & (F.col("transaction_status") == COMPLETED))


def success_summary(tx: DataFrame) -> DataFrame:
    """First, last, count, volume and target-rate flag of each user's completed exchanges."""
    return (
        successful(tx)
        .groupBy("user_id")
        .agg(
            F.min("transaction_timestamp").alias("first_successful_transaction_at"),
            F.max("transaction_timestamp").alias("last_successful_transaction_at"),
            F.count(F.lit(1)).alias("successful_transaction_count"),
            exact_sum("transaction_amount_krw").alias("successful_transaction_volume"),
            any_flag(F.col("order_type") == TARGET_RATE_ORDER).alias("target_rate_user_flag"),
        )
    )


def event_flag(events: DataFrame, name: str, flag: str) -> DataFrame:
    """Users with at least one event called ``name``.  Duplicated events change nothing: it is a set."""
    return events.where(F.col("event_name") == name).select("user_id").distinct().withColumn(flag, F.lit(1))


def onboarding_valid(first: Column | None = None, kyc: Column | None = None) -> Column:
    """0 for a completed exchange without KYC, else 1."""
    first = F.col("first_successful_transaction_at") if first is None else first
    kyc = F.col("kyc_completed_at") if kyc is None else kyc
    return F.when(first.isNotNull() & kyc.isNull(), 0).otherwise(1)


def activation(n_days: int = 14) -> Column:
    """KYC, bank link and first exchange all present, the exchange within ``n_days`` of signup."""
    complete = (
        F.col("kyc_completed_at").isNotNull()
        & F.col("bank_account_linked_at").isNotNull()
        & F.col("first_successful_transaction_at").isNotNull()
    )
    in_time = within_days("signup_timestamp", "first_successful_transaction_at", n_days)
    return F.when(complete & in_time, 1).otherwise(0)


def user_lifecycle(users: DataFrame, tx: DataFrame, events: DataFrame, activation_days: int = 14) -> DataFrame:
    """One row per user.

    Both fact tables shrink to one row per user with map-side combining before they meet ``users``, so a
    user holding a large share of the facts never makes a large join group.
    """
    joined = users.join(success_summary(tx), "user_id", "left").join(
        event_flag(events, RATE_ALERT_EVENT, "rate_alert_user_flag"), "user_id", "left"
    )
    return lifecycle_columns(joined, activation_days)


def lifecycle_columns(joined: DataFrame, activation_days: int = 14) -> DataFrame:
    """The mart's columns from users with their summaries beside them."""
    first = "first_successful_transaction_at"
    derived = {
        "days_to_kyc": round_half_up(elapsed("signup_timestamp", "kyc_completed_at"), 2),
        "activation_days_exact": round_half_up(elapsed("signup_timestamp", first), 2),
        "activation_hours": round_half_up(elapsed("signup_timestamp", first, "hour"), 2),
        "successful_transaction_count": F.coalesce("successful_transaction_count", F.lit(0).cast("long")),
        "successful_transaction_volume": F.coalesce("successful_transaction_volume", F.lit(0.0)),
        "target_rate_user_flag": F.coalesce("target_rate_user_flag", F.lit(0)),
        "rate_alert_user_flag": F.coalesce("rate_alert_user_flag", F.lit(0)),
        "onboarding_valid_flag": onboarding_valid(),
        "activation_flag": activation(activation_days),
    }
    return joined.withColumns(derived).select(*MART_COLUMNS)


def valid_users(mart: DataFrame) -> DataFrame:
    return mart.where(F.col("onboarding_valid_flag") == 1)


def user_context(mart: DataFrame) -> DataFrame:
    """The lifecycle columns the targeting rules read."""
    return mart.select(
        "user_id",
        "acquisition_channel",
        "successful_transaction_count",
        "successful_transaction_volume",
        "target_rate_user_flag",
        "rate_alert_user_flag",
    )

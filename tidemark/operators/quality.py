"""Data-quality checks.  Each gives rows of one layout, so reports are unions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.labels import not_in_domain
from tidemark.functions.numeric import ratio
from tidemark.functions.temporal import unparseable
from tidemark.operators.cleaning import EVENT_KEY, key_counts
from tidemark.operators.joins import orphans, salted_join
from tidemark.operators.lifecycle import COMPLETED, FAILED, exchanges
from tidemark.operators.ranking import exact_quantiles

# Fixed layout and texts of the issue report.
ISSUE_COLUMNS = ("check", "table", "column", "issue_count", "severity", "detail")
MISSING_DETAIL = "Review whether the field is conditionally optional."
VALIDITY_TABLES = "users / events / transactions"
VALIDITY_COLUMN = "see check name"
VALIDITY_DETAIL = "Logic-based validity check."
LEAKAGE_DETAIL = "All selected features are measured on or before observation_date."
CHANNELS = ("organic_search", "paid_social", "referral", "affiliate", "direct", "content", "other")
PROHIBITED_FEATURES = ("target_repeat_30d", "next_transaction_date", "future_transaction_count")


def _missing(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    return c.isNull() | (c == "") if isinstance(df.schema[name].dataType, T.StringType) else c.isNull()


def missing_rates(df: DataFrame) -> DataFrame:
    """Missing count and rate of every column: one scan for all columns, then one row per column."""
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(_missing(df, c)).alias(f"m_{i}") for i, c in enumerate(df.columns)]
    )
    rows = [
        F.struct(F.lit(c).alias("column"), F.col(f"m_{i}").alias("missing_count")) for i, c in enumerate(df.columns)
    ]
    long = counted.select("_rows", F.inline(F.array(*rows)))
    return long.select("column", "missing_count", ratio("missing_count", "_rows").alias("missing_rate"))


def issue(
    counted: DataFrame, check: str, table: str, column: str | Column, severity: str, detail: str | Column
) -> DataFrame:
    """Bring an ``issue_count`` frame into the report layout."""
    return counted.select(
        F.lit(check).alias("check"),
        F.lit(table).alias("table"),
        (F.lit(column) if isinstance(column, str) else column).alias("column"),
        F.col("issue_count").cast("long").alias("issue_count"),
        F.lit(severity).alias("severity"),
        (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"),
    )


def missing_values(df: DataFrame, table: str) -> DataFrame:
    """Columns with at least one NULL or empty value."""
    found = missing_rates(df).where("missing_count > 0").withColumnRenamed("missing_count", "issue_count")
    return issue(found, "missing_values", table, F.col("column"), "warning", MISSING_DETAIL)


def scan_checks(df: DataFrame, table: str, conditions: Mapping[str, Column]) -> DataFrame:
    """Missing values of every column and the row-level validity ``conditions`` of a table, in one scan."""
    aggs, rows = [], []
    for i, c in enumerate(df.columns):
        aggs.append(F.count_if(_missing(df, c)).alias(f"m_{i}"))
        rows.append(("missing_values", table, c, f"m_{i}", "warning", MISSING_DETAIL))
    for i, (check, condition) in enumerate(conditions.items()):
        aggs.append(F.count_if(condition).alias(f"v_{i}"))
        rows.append((check, VALIDITY_TABLES, VALIDITY_COLUMN, f"v_{i}", "error", VALIDITY_DETAIL))
    cells = [
        F.struct(
            F.lit(check).alias("check"),
            F.lit(where).alias("table"),
            F.lit(column).alias("column"),
            F.col(count).alias("issue_count"),
            F.lit(severity).alias("severity"),
            F.lit(detail).alias("detail"),
        )
        for check, where, column, count, severity, detail in rows
    ]
    found = df.agg(*aggs).select(F.inline(F.array(*cells)))
    return found.where((F.col("check") != "missing_values") | (F.col("issue_count") > 0))


def count_issues(df: DataFrame, condition: Column) -> DataFrame:
    return df.agg(F.count_if(condition).alias("issue_count"))


def dup_count(df: DataFrame, key: str) -> DataFrame:
    """Rows minus distinct non-NULL keys."""
    return df.agg((F.count(F.lit(1)) - F.countDistinct(key)).alias("issue_count"))


def dup_rows(df: DataFrame, keys: Sequence[str] = EVENT_KEY) -> DataFrame:
    """Rows beyond the first of each composite key."""
    return key_counts(df, keys).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("issue_count"))


def dup_groups(df: DataFrame, keys: Sequence[str] = EVENT_KEY) -> DataFrame:
    """Composite keys that occur more than once."""
    return key_counts(df, keys).where("n > 1").agg(F.count(F.lit(1)).alias("duplicate_event_records"))


def bad_ts(df: DataFrame, column: str) -> DataFrame:
    return count_issues(df, unparseable(column))


def order_violation(df: DataFrame, earlier: str, later: str) -> DataFrame:
    """Rows where ``earlier`` lies before ``later`` although it must follow it."""
    return count_issues(df, F.col(earlier) < F.col(later))


def tx_before_signup(tx: DataFrame, users: DataFrame) -> DataFrame:
    """Transactions dated before the user's signup; equal instants of a user are counted before the join."""
    instants = key_counts(tx.where(F.col("user_id").isNotNull()), ["user_id", "transaction_timestamp"])
    signups = users.select("user_id", "signup_timestamp")
    early = salted_join(instants, signups, "user_id").where("transaction_timestamp < signup_timestamp")
    return early.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("issue_count"))


def nonpositive(df: DataFrame, column: str) -> DataFrame:
    return count_issues(df, F.col(column) <= 0)


def domain_violation(df: DataFrame, column: str, allowed: Sequence[str] = CHANNELS) -> DataFrame:
    return count_issues(df, not_in_domain(column, allowed))


def iqr_outliers(df: DataFrame, column: str, k: float = 3.0) -> DataFrame:
    """Upper outliers of the positive values: quartiles, threshold Q3 + k * IQR and rows above it."""
    positive = df.where(F.col(column) > 0)
    q1, q3 = exact_quantiles(positive, column, [0.25, 0.75])
    threshold = None if q1 is None else q3 + k * (q3 - q1)
    as_double = [F.lit(v).cast("double") for v in (q1, q3, threshold)]
    return positive.agg(
        *[v.alias(n) for v, n in zip(as_double, ("q1", "q3", "threshold"))],
        F.count_if(F.col(column) > as_double[2]).alias("issue_count"),
    )


def leakage(spark: SparkSession, features: Iterable[str], prohibited: Iterable[str] = PROHIBITED_FEATURES) -> DataFrame:
    """Features that must not be used; a comparison of column names only."""
    found = overlap(features, prohibited)
    return spark.range(1).select(F.lit(len(found)).alias("issue_count"))


def overlap(a: Iterable[str], b: Iterable[str]) -> list[str]:
    return sorted(set(a) & set(b))


def orphan_rows(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return orphans(child, parent, key).agg(F.coalesce(F.sum("orphan_rows"), F.lit(0)).alias("issue_count"))


def conditional_presence(df: DataFrame, condition: Column, column: str, present: bool) -> DataFrame:
    """Rows under ``condition`` whose ``column`` is (``present``) or is not there."""
    there = F.col(column).isNotNull()
    return count_issues(df, condition & (there if present else ~there))


def executed_rate_checks(tx: DataFrame) -> DataFrame:
    """Completed exchanges without a rate, failed ones with a rate: one pass."""
    status, rate = F.col("transaction_status"), F.col("executed_rate")
    return exchanges(tx).agg(
        F.count_if((status == COMPLETED) & rate.isNull()).alias("completed_without_rate"),
        F.count_if((status == FAILED) & rate.isNotNull()).alias("failed_with_rate"),
    )


# Fixed labels of the invalid-onboarding breakdown.
WITHIN_LABEL = "Successful exchange within 14 days"
AFTER_LABEL = "Successful exchange after 14 days"


def invalid_timing(mart: DataFrame, n_days: int = 14) -> DataFrame:
    """Users with an invalid onboarding sequence, by how soon they exchanged."""
    early = F.col("activation_days_exact") <= n_days
    label = F.when(early, WITHIN_LABEL).otherwise(AFTER_LABEL)
    invalid = mart.where(F.col("onboarding_valid_flag") == 0)
    return invalid.groupBy(label.alias("timing")).agg(F.count(F.lit(1)).alias("users")).orderBy("timing")


def union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def dq_report(
    tables: Mapping[str, DataFrame],
    mart: DataFrame,
    features: Sequence[str],
    allowed_channels: Sequence[str] = CHANNELS,
    texts: Mapping[str, Column] | None = None,
) -> DataFrame:
    """All checks as one report.  ``tables``: name to frame; users, events and transactions are required.

    ``texts``: for a table, its timestamps as the source wrote them, over the columns of its frame.  Timestamps that
    are typed already have nothing unreadable left, so date checks need these to find anything.
    """
    users, events, tx = tables["users"], tables["events"], tables["transactions"]
    written = {"users": "signup_timestamp", "events": "event_timestamp", "transactions": "transaction_timestamp"} | dict(texts or {})
    row_checks = {
        "users": {
            "invalid_signup_date": unparseable(written["users"]),
            "invalid_acquisition_channel": not_in_domain("acquisition_channel", allowed_channels),
        },
        "events": {"invalid_event_date": unparseable(written["events"])},
        "transactions": {
            "invalid_transaction_date": unparseable(written["transactions"]),
            "nonpositive_transaction_volume": F.col("transaction_amount_krw") <= 0,
        },
    }
    across = {
        "activation_before_signup": order_violation(mart, "first_successful_transaction_at", "signup_timestamp"),
        "transaction_before_signup": tx_before_signup(tx, users),
    }
    outliers = iqr_outliers(tx, "transaction_amount_krw")
    told = F.concat(
        F.lit("Above Q3 + 3*IQR threshold of KRW "), F.format_number("threshold", 0), F.lit("; retained.")
    )
    return union(
        [
            *[scan_checks(df, name, row_checks.get(name, {})) for name, df in tables.items()],
            issue(
                dup_count(users, "user_id"),
                "duplicate_user_id", "users", "user_id", "error", "Each user_id should identify one user.",
            ),
            issue(
                dup_count(tx, "transaction_id"),
                "duplicate_transaction_id", "transactions", "transaction_id", "error",
                "Each transaction_id should identify one transaction.",
            ),
            issue(
                dup_rows(events),
                "duplicate_event_rows", "events", ", ".join(EVENT_KEY), "warning",
                "clean_events keeps one row for each duplicated event key.",
            ),
            *[
                issue(df, check, VALIDITY_TABLES, VALIDITY_COLUMN, "error", VALIDITY_DETAIL)
                for check, df in across.items()
            ],
            issue(
                outliers,
                "transaction_volume_outlier", "transactions", "transaction_amount_krw", "review", told,
            ),
            issue(
                leakage(tx.sparkSession, features),
                "repeat_model_target_leakage", "modeling_user_month_snapshots", "repeat model features", "error",
                LEAKAGE_DETAIL,
            ),
        ]
    )


def dq_summary(issues: DataFrame) -> DataFrame:
    """Checks, checks with findings and affected rows per severity and overall."""
    return (
        issues.rollup("severity")
        .agg(
            F.count("check").alias("checks"),
            F.count_if(F.col("issue_count") > 0).alias("checks_with_issues"),
            F.sum("issue_count").alias("affected_rows"),
            F.grouping("severity").alias("_all"),
        )
        .orderBy(F.desc("_all"), "severity")
        .select(
            F.when(F.col("_all") == 1, "all").otherwise(F.col("severity")).alias("severity"),
            "checks",
            "checks_with_issues",
            "affected_rows",
        )
    )


def open_issues(issues: DataFrame) -> DataFrame:
    return issues.where("issue_count > 0")

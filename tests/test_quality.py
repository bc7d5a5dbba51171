from __future__ import annotations

import pytest
from helpers import events, plan, rows, tx, users
from pyspark.sql import functions as F

from tidemark.operators import quality


@pytest.fixture(scope="module")
def tables(spark):
    s = "2024-01-10T00:00:00"
    return {
        "users": users(spark, [(1, s, "direct", s, s), (2, s, "nowhere", None, s), (2, s, None, s, None), (3, s, "", s, s)]),
        "events": events(spark, [(1, 1, "s", s, "view"), (2, 1, "s", s, "view"), (3, 1, "s", s, "view"), (4, 9, "s", s, "")]),
        "transactions": tx(
            spark,
            [(1, "2024-01-09T00:00:00", {"amount": -1.0}), (1, "2024-01-09T00:00:00"), (2, s, {"amount": 0.0}), (2, s)],
        ),
    }


def first(df):
    return df.head()["issue_count"]


def test_missing(tables):
    got = {r["column"]: r["issue_count"] for r in quality.missing_values(tables["users"], "users").collect()}
    assert got == {"acquisition_channel": 2, "kyc_completed_at": 1, "bank_account_linked_at": 1}
    assert plan(quality.missing_rates(tables["users"])).count("Scan ExistingRDD") == 1


def test_duplicates(tables):
    assert first(quality.dup_count(tables["users"], "user_id")) == 1
    assert first(quality.dup_rows(tables["events"])) == 2
    assert quality.dup_groups(tables["events"]).head()[0] == 1


def test_row_checks(spark, tables):
    assert first(quality.nonpositive(tables["transactions"], "transaction_amount_krw")) == 2
    assert first(quality.domain_violation(tables["users"], "acquisition_channel")) == 3
    assert first(quality.tx_before_signup(tables["transactions"], tables["users"].where("user_id = 1"))) == 2
    assert first(quality.orphan_rows(tables["events"], tables["users"], "user_id")) == 1
    text = spark.createDataFrame([("2024-01-01",), ("soon",), (None,)], "s string")
    assert first(quality.bad_ts(text, "s")) == 1
    present = quality.conditional_presence(tables["transactions"], F.col("transaction_status") == "completed", "executed_rate", False)
    assert first(present) == 0
    assert tuple(quality.executed_rate_checks(tables["transactions"]).head()) == (0, 0)


def test_iqr(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 100, -3, 0]], "x double")
    got = quality.iqr_outliers(df, "x", 3.0).head()
    assert (got["q1"], got["q3"], got["threshold"], got["issue_count"]) == (2.25, 4.75, 12.25, 1)


def test_leakage_is_computed(spark):
    assert first(quality.leakage(spark, ["recency_days"])) == 0
    assert first(quality.leakage(spark, ["recency_days", "target_repeat_30d"])) == 1


def test_invalid_timing(spark):
    mart = spark.createDataFrame([(0, 14.0), (0, 14.01), (0, 2.0), (1, 1.0)], "onboarding_valid_flag int, activation_days_exact double")
    assert rows(quality.invalid_timing(mart)) == [(quality.AFTER_LABEL, 1), (quality.WITHIN_LABEL, 2)]


def test_report_and_summary(spark, tables):
    mart = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01' AS first_successful_transaction_at, TIMESTAMP_NTZ'2024-01-02' AS signup_timestamp")
    report = quality.dq_report(tables, mart, ["recency_days"])
    assert tuple(report.columns) == quality.ISSUE_COLUMNS
    found = {(r["check"], r["column"]): r["issue_count"] for r in report.collect()}
    assert found[("activation_before_signup", quality.VALIDITY_COLUMN)] == 1
    assert found[("duplicate_event_rows", "user_id, session_id, event_timestamp, event_name")] == 2
    assert found[("nonpositive_transaction_volume", quality.VALIDITY_COLUMN)] == 2
    summary = [tuple(r) for r in quality.dq_summary(report).collect()]
    assert summary[0][0] == "all" and summary[0][1] == len(found)
    assert summary[0][3] == sum(found.values())
    assert quality.open_issues(report).count() == sum(v > 0 for v in found.values())

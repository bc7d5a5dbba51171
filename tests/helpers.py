"""Small frames and plan checks shared by the tests."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

USERS = (
    "user_id long, signup_timestamp timestamp_ntz, acquisition_channel string, kyc_completed_at timestamp_ntz, "
    "bank_account_linked_at timestamp_ntz"
)
TX = (
    "transaction_id long, user_id long, transaction_timestamp timestamp_ntz, transaction_type string, "
    "order_type string, transaction_amount_krw double, fee_amount_krw double, transaction_status string, "
    "failure_reason string, executed_rate double, market_regime_at_transaction string"
)
EVENTS = "event_id long, user_id long, session_id string, event_timestamp timestamp_ntz, event_name string"


def ts(text: str) -> datetime:
    return datetime.fromisoformat(text)


def users(spark: SparkSession, rows) -> DataFrame:
    """Rows of (user, signup, channel, kyc, bank)."""
    made = [(u, ts(s), c, k and ts(k), b and ts(b)) for u, s, c, k, b in rows]
    return spark.createDataFrame(made, USERS)


def tx(spark: SparkSession, rows) -> DataFrame:
    """Rows of (user, time[, overrides])."""
    out = []
    for i, (user, at, *rest) in enumerate(rows):
        r = {
            "type": "exchange",
            "order": "manual",
            "amount": 100.0,
            "status": "completed",
            "reason": None,
            "regime": "low",
            **(rest[0] if rest else {}),
        }
        rate = 1.0 if r["status"] == "completed" else None
        out.append(
            (i, user, at and ts(at), r["type"], r["order"], r["amount"], r["amount"] and r["amount"] * 0.00025,
             r["status"], r["reason"], rate, r["regime"])
        )
    return spark.createDataFrame(out, TX)


def events(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame([(e, u, s, t and ts(t), n) for e, u, s, t, n in rows], EVENTS)


def rows(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()

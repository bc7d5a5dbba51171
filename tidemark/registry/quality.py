"""Data-quality checks.  The test tables are clean, so some checks plant defects by rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import quality
from tidemark.operators.snapshots import REPEAT_FEATURES
from tidemark.registry.base import query, rnd
from tidemark.sources.stand_in import CHANNELS

_KEYS = "user_id, session_id, event_timestamp, event_name"
_TX = (
    "transaction_id, user_id, transaction_timestamp, transaction_type, order_type, transaction_amount_krw, "
    "fee_amount_krw, transaction_status, failure_reason, executed_rate, market_regime_at_transaction"
).split(", ")
_USERS = "user_id, signup_timestamp, acquisition_channel, kyc_completed_at, bank_account_linked_at".split(", ")
_EVENTS = "event_id, user_id, session_id, event_timestamp, event_name".split(", ")
_TICKETS = "ticket_id, user_id, resolution_time_hours, satisfaction_score".split(", ")
_SPEND = "date, channel, spend_krw, impressions, campaign_id".split(", ")
_SNAPS = (
    "user_id, observation_date, recency_days, transactions_90d, transactions_all, total_volume_90d, "
    "failed_ratio_90d, target_repeat_30d"
).split(", ")
_CHECKED = {
    "users": ("app_users", _USERS),
    "events": ("app_events", _EVENTS),
    "transactions": ("app_tx", _TX),
    "support_tickets": ("app_tickets", _TICKETS),
    "marketing_spend": ("app_spend", _SPEND),
    "modeling_user_month_snapshots": ("snaps", _SNAPS),
}


def _missing_sql(name: str) -> str:
    source, columns = _CHECKED[name]
    return " UNION ALL ".join(
        f"""SELECT 'missing_values' AS "check", '{name}' AS "table", '{c}' AS "column",
                   COUNT(*) FILTER (WHERE "{c}" IS NULL OR CAST("{c}" AS VARCHAR) = '') AS issue_count,
                   'warning' AS severity, '{quality.MISSING_DETAIL}' AS detail FROM {source}"""
        for c in columns
    )


def _checked(t):
    return {n: t.all[n].select(*columns) for n, (_, columns) in _CHECKED.items()}


@query("q1_missing_values", f"SELECT * FROM ({_missing_sql('transactions')}) WHERE issue_count > 0")
def q1(t):
    return quality.missing_values(t.tx.select(*_TX), "transactions")


@query(
    "q1b_missing_rates",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", COUNT(*) - COUNT("{c}") AS missing_count,
                   CAST(COUNT(*) - COUNT("{c}") AS DOUBLE) / COUNT(*) AS missing_rate FROM app_users"""
        for c in _USERS
    ),
)
def q1b(t):
    return quality.missing_rates(t.users)


@query("q2_duplicate_ids", "SELECT COUNT(*) - COUNT(DISTINCT user_id) AS issue_count FROM app_events")
def q2(t):
    return quality.dup_count(t.events, "user_id")


@query("q3_duplicate_rows", f"SELECT COUNT(*) - COUNT(DISTINCT ({_KEYS})) AS issue_count FROM app_events")
def q3(t):
    return quality.dup_rows(t.events)


@query(
    "q4_duplicate_groups",
    f"""SELECT COUNT(*) AS duplicate_event_records
        FROM (SELECT 1 FROM app_events GROUP BY {_KEYS} HAVING COUNT(*) > 1)""",
)
def q4(t):
    return quality.dup_groups(t.events)


@query(
    "q5_bad_timestamps",
    """SELECT COUNT(*) FILTER (WHERE try_cast(s AS TIMESTAMP) IS NULL AND s IS NOT NULL) AS issue_count
       FROM (SELECT CASE WHEN event_id % 97 = 0 THEN 'not a date' WHEN event_id % 89 = 0 THEN '2024-13-45 00:00:00'
                         WHEN event_id % 83 = 0 THEN NULL ELSE CAST(ts AS VARCHAR) END AS s FROM events)""",
)
def q5(t):
    """Event times as text with planted defects."""
    k = F.col("event_id")
    text = (
        F.when(k % 97 == 0, "not a date")
        .when(k % 89 == 0, "2024-13-45 00:00:00")
        .when(k % 83 != 0, F.col("ts").cast("string"))
    )
    return quality.bad_ts(t.raw("events").select(text.alias("s")), "s")


@query("q6_activation_before_signup", "SELECT COUNT(*) FILTER (WHERE first_successful_transaction_at < kyc_completed_at) AS issue_count FROM mart")
def q6(t):
    return quality.order_violation(t.mart, "first_successful_transaction_at", "kyc_completed_at")


@query(
    "q7_tx_before_signup",
    """SELECT COUNT(*) AS issue_count FROM app_tx t JOIN app_users u ON u.user_id = t.user_id
       WHERE t.transaction_timestamp < u.signup_timestamp + INTERVAL 20 DAY""",
)
def q7(t):
    """With signup moved 20 days on, so that there is something to find."""
    later = t.users.withColumn("signup_timestamp", F.col("signup_timestamp") + F.make_dt_interval(F.lit(20)))
    return quality.tx_before_signup(t.tx, later)


@query("q8_nonpositive_amounts", "SELECT COUNT(*) FILTER (WHERE transaction_amount_krw <= 0) AS issue_count FROM app_tx")
def q8(t):
    return quality.nonpositive(t.tx, "transaction_amount_krw")


@query(
    "q9_domain_violations",
    """SELECT COUNT(*) FILTER (WHERE acquisition_channel NOT IN ('AUTOMOBILE', 'BUILDING')
              OR acquisition_channel IS NULL) AS issue_count FROM app_users""",
)
def q9(t):
    return quality.domain_violation(t.users, "acquisition_channel", ["AUTOMOBILE", "BUILDING"])


_IQR = """(SELECT quantile_cont(transaction_amount_krw, 0.25) AS q1, quantile_cont(transaction_amount_krw, 0.75) AS q3
           FROM app_tx WHERE transaction_amount_krw > 0)"""


@query(
    "q10_iqr_outliers",
    f"""SELECT {rnd("q1", 6)} AS q1, {rnd("q3", 6)} AS q3, {rnd("q3 + 0.5 * (q3 - q1)", 6)} AS threshold,
               (SELECT COUNT(*) FROM app_tx WHERE transaction_amount_krw > q3 + 0.5 * (q3 - q1)) AS issue_count
        FROM {_IQR}""",
)
def q10(t):
    """A factor of 0.5, for the uniform amounts have nothing beyond 3."""
    from tidemark.functions.numeric import round_half_up

    found = quality.iqr_outliers(t.tx, "transaction_amount_krw", 0.5)
    return found.withColumns({c: round_half_up(c, 6) for c in ("q1", "q3", "threshold")})


@query("q12_orphans", "SELECT COUNT(*) AS issue_count FROM app_events WHERE user_id NOT IN (SELECT user_id FROM app_users WHERE user_id % 2 = 0)")
def q12(t):
    return quality.orphan_rows(t.events, t.users.where("user_id % 2 = 0"), "user_id")


@query(
    "q13_executed_rate",
    """SELECT COUNT(*) FILTER (WHERE transaction_status = 'completed' AND executed_rate IS NULL)
              AS completed_without_rate,
              COUNT(*) FILTER (WHERE transaction_status = 'failed' AND executed_rate IS NOT NULL) AS failed_with_rate
       FROM tries""",
)
def q13(t):
    return quality.executed_rate_checks(t.tx)


@query(
    "q13b_conditional_presence",
    """SELECT COUNT(*) AS issue_count FROM app_tx WHERE order_type = 'target_rate' AND failure_reason IS NOT NULL""",
)
def q13b(t):
    return quality.conditional_presence(t.tx, F.col("order_type") == "target_rate", "failure_reason", True)


@query(
    "q14_invalid_timing",
    f"""SELECT CASE WHEN activation_days_exact <= 14 THEN '{quality.WITHIN_LABEL}' ELSE '{quality.AFTER_LABEL}' END
               AS timing, COUNT(*) AS users FROM mart WHERE onboarding_valid_flag = 0 GROUP BY 1""",
)
def q14(t):
    return quality.invalid_timing(t.mart)


def _row(check, table, column, severity, detail, count):
    return f"""SELECT '{check}' AS "check", '{table}' AS "table", '{column}' AS "column",
                      CAST(({count}) AS BIGINT) AS issue_count, '{severity}' AS severity, {detail} AS detail"""


def _unreadable(table: str, key: str, column: str) -> str:
    return f"""SELECT COUNT(*) FILTER (WHERE s IS NOT NULL AND try_cast(s AS TIMESTAMP) IS NULL)
               FROM (SELECT CASE WHEN {key} % 97 = 0 THEN 'not a date' WHEN {key} % 89 = 0 THEN '2024-13-45 00:00:00'
                                 WHEN {key} % 83 = 0 THEN NULL ELSE CAST({column} AS VARCHAR) END AS s FROM {table})"""


def _written(key: str, column: str):
    """A typed timestamp as a source might have written it, with planted defects."""
    k = F.col(key)
    return F.when(k % 97 == 0, "not a date").when(k % 89 == 0, "2024-13-45 00:00:00").when(k % 83 != 0, F.col(column).cast("string"))


_V = (quality.VALIDITY_TABLES, quality.VALIDITY_COLUMN, "error", f"'{quality.VALIDITY_DETAIL}'")
_DOMAIN = ", ".join(f"'{c}'" for c in CHANNELS[:4])
_REPORT = " UNION ALL ".join(
    [
        *[f"SELECT * FROM ({_missing_sql(n)}) WHERE issue_count > 0" for n in _CHECKED],
        _row(
            "duplicate_user_id", "users", "user_id", "error", "'Each user_id should identify one user.'",
            "SELECT COUNT(*) - COUNT(DISTINCT user_id) FROM app_users",
        ),
        _row(
            "duplicate_transaction_id", "transactions", "transaction_id", "error",
            "'Each transaction_id should identify one transaction.'",
            "SELECT COUNT(*) - COUNT(DISTINCT transaction_id) FROM app_tx",
        ),
        _row(
            "duplicate_event_rows", "events", _KEYS, "warning",
            "'clean_events keeps one row for each duplicated event key.'",
            f"SELECT COUNT(*) - COUNT(DISTINCT ({_KEYS})) FROM app_events",
        ),
        *[
            _row(check, *_V, count)
            for check, count in {
                "invalid_signup_date": _unreadable("app_users", "user_id", "signup_timestamp"),
                "invalid_event_date": _unreadable("app_events", "event_id", "event_timestamp"),
                "invalid_transaction_date": _unreadable("app_tx", "transaction_id", "transaction_timestamp"),
                "activation_before_signup": "SELECT COUNT(*) FROM mart WHERE first_successful_transaction_at < signup_timestamp",
                "transaction_before_signup": """SELECT COUNT(*) FROM app_tx t JOIN app_users u ON u.user_id = t.user_id
                                                WHERE t.transaction_timestamp < u.signup_timestamp""",
                "nonpositive_transaction_volume": "SELECT COUNT(*) FROM app_tx WHERE transaction_amount_krw <= 0",
                "invalid_acquisition_channel": f"""SELECT COUNT(*) FROM app_users
                    WHERE acquisition_channel NOT IN ({_DOMAIN}) OR acquisition_channel IS NULL""",
            }.items()
        ],
        _row(
            "transaction_volume_outlier", "transactions", "transaction_amount_krw", "review",
            f"""(SELECT 'Above Q3 + 3*IQR threshold of KRW ' || format('{{:,}}', CAST(round_even(q3 + 3 * (q3 - q1), 0) AS BIGINT))
                        || '; retained.' FROM {_IQR})""",
            f"SELECT COUNT(*) FROM app_tx WHERE transaction_amount_krw > (SELECT q3 + 3 * (q3 - q1) FROM {_IQR})",
        ),
        _row(
            "repeat_model_target_leakage", "modeling_user_month_snapshots", "repeat model features", "error",
            f"'{quality.LEAKAGE_DETAIL}'", "SELECT 0",
        ),
    ]
)


def _report(t):
    texts = {
        "users": _written("user_id", "signup_timestamp"),
        "events": _written("event_id", "event_timestamp"),
        "transactions": _written("transaction_id", "transaction_timestamp"),
    }
    return quality.dq_report(_checked(t), t.mart, REPEAT_FEATURES, CHANNELS[:4], texts)


@query("q15_issue_report", _REPORT)
def q15(t):
    return _report(t)


@query(
    "q16_dq_summary",
    f"""SELECT COALESCE(severity, 'all') AS severity, COUNT(*) AS checks,
               COUNT(*) FILTER (WHERE issue_count > 0) AS checks_with_issues,
               CAST(SUM(issue_count) AS BIGINT) AS affected_rows FROM ({_REPORT}) GROUP BY ROLLUP (severity)""",
)
def q16(t):
    return quality.dq_summary(_report(t))


@query("q17_open_issues", f"SELECT * FROM ({_REPORT}) WHERE issue_count > 0")
def q17(t):
    return quality.open_issues(_report(t))

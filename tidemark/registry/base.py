"""Registration of queries and the common table expressions their SQL statements start with."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.stand_in import ProductTables


@dataclass(frozen=True)
class Query:
    build: Callable[[ProductTables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``<id>_<name>``; without ``sql`` it is checked by tests only."""

    def add(build: Callable[[ProductTables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = Query(build, sql)
        return build

    return add


def _dates_as_text(df: DataFrame) -> DataFrame:
    """Dates leave as ISO text, as they do in a CSV extract."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("string").alias(f.name) if isinstance(f.dataType, T.DateType) else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build):
        return lambda spark, directory: _dates_as_text(build(ProductTables(spark, directory)))

    return {name: bind(q.build) for name, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_tables(q.sql) for name, q in REGISTRY.items() if q.sql is not None}


def rnd(x: str, digits: int = 2) -> str:
    """Half away from zero on the binary value of a non-negative number."""
    return f"(floor(CAST({x} AS DOUBLE) * 1e{digits} + 0.5) / 1e{digits})"


def signed_rnd(x: str, digits: int) -> str:
    return f"(sign({x}) * floor(abs(CAST({x} AS DOUBLE)) * 1e{digits} + 0.5) / 1e{digits})"


def pct(a: str, b: str, digits: int = 2) -> str:
    return rnd(f"1e2 * CAST({a} AS DOUBLE) / NULLIF({b}, 0)", digits)


def money(x: str, tail: str = "") -> str:
    return f"CAST(SUM(CAST({x} AS DECIMAL(28,8))){tail} AS DOUBLE)"


def money_avg(x: str) -> str:
    return f"({money(x)} / NULLIF(COUNT({x}), 0))"


REGIME = "CASE WHEN {k} % 7 < 3 THEN 'low' WHEN {k} % 7 < 6 THEN 'normal' ELSE 'high' END"

# In dependency order: a table may use the ones before it.
TABLES = {
    "app_users": """
        SELECT user_id, signup_timestamp, acquisition_channel,
               CASE WHEN user_id % 4 <> 1 THEN signup_timestamp + to_days(CAST(user_id % 5 AS INTEGER)) END
                   AS kyc_completed_at,
               CASE WHEN user_id % 4 <> 1 AND user_id % 6 <> 2
                    THEN signup_timestamp + to_days(CAST(user_id % 5 + 1 AS INTEGER)) END AS bank_account_linked_at
        FROM (SELECT c_custkey AS user_id, c_mktsegment AS acquisition_channel,
                     COALESCE(d, TIMESTAMP '1995-01-01') - to_days(CAST(c_custkey % 23 AS INTEGER))
                         AS signup_timestamp
              FROM customer
              LEFT JOIN (SELECT o_custkey, MIN(o_orderdate) AS d FROM orders GROUP BY ALL) f
                     ON f.o_custkey = c_custkey)""",
    "app_tx": f"""
        SELECT *, amount AS transaction_amount_krw, amount * CAST(0.00025 AS DOUBLE) AS fee_amount_krw,
               CASE WHEN failed THEN 'failed' ELSE 'completed' END AS transaction_status,
               CASE WHEN failed THEN o_orderpriority END AS failure_reason,
               CASE WHEN NOT failed THEN CAST(1 AS DOUBLE) END AS executed_rate
        FROM (SELECT o_orderkey AS transaction_id, o_custkey AS user_id, o_orderdate AS transaction_timestamp,
                     CASE WHEN o_orderkey % 20 = 0 THEN 'deposit' ELSE 'exchange' END AS transaction_type,
                     CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 3 = 0
                          THEN 'target_rate' ELSE 'manual' END AS order_type,
                     CASE WHEN o_orderkey % 400 = 0 THEN CAST(0 AS DOUBLE) ELSE o_totalprice END AS amount,
                     o_orderstatus = 'P' OR (o_custkey % 4 = 1 AND o_custkey % 40 <> 1) AS failed,
                     {REGIME.format(k="o_orderkey")} AS market_regime_at_transaction, o_orderpriority
              FROM orders)""",
    "app_events": """
        SELECT event_id, user_id, CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id,
               CAST(date_trunc('hour', ts) AS TIMESTAMP) AS event_timestamp,
               CASE WHEN event_type = 'click' AND user_id % 3 = 0 THEN 'rate_alert_created' ELSE event_type END
                   AS event_name
        FROM events""",
    "app_tickets": """
        SELECT conv_id AS ticket_id, conv_id % 70 AS user_id, CAST(COUNT(*) AS DOUBLE) AS resolution_time_hours,
               CAST(1 + conv_id % 5 AS DOUBLE) AS satisfaction_score
        FROM conversations GROUP BY conv_id""",
    "app_rates": f"""
        SELECT date_trunc('hour', ts) AS "timestamp", event_type AS currency_pair,
               {money_avg("value")} AS close_rate,
               {REGIME.format(k="hour(date_trunc('hour', ts))")} AS market_regime
        FROM events GROUP BY ALL""",
    "app_spend": f"""
        SELECT CAST(ts AS DATE) AS "date", event_type AS channel, {money("value")} AS spend_krw,
               COUNT(*) AS impressions, CASE WHEN event_type <> 'error' THEN 'c-' || event_type END AS campaign_id
        FROM events GROUP BY ALL""",
    "app_fx": f"""
        SELECT l_returnflag AS pair, CAST(l_shipdate AS DATE) AS "date", MIN(l_extendedprice) AS open,
               MAX(l_extendedprice) AS high, MIN(l_extendedprice) AS low, {money_avg("l_extendedprice")} AS close
        FROM lineitem GROUP BY ALL""",
    "tries": "SELECT * FROM app_tx WHERE transaction_type = 'exchange'",
    "wins": "SELECT * FROM tries WHERE transaction_status = 'completed'",
    "per_user": f"""
        SELECT user_id, MIN(transaction_timestamp) AS f, MAX(transaction_timestamp) AS l, COUNT(*) AS n,
               {money("transaction_amount_krw")} AS v, {money("fee_amount_krw")} AS fee,
               MAX(CAST(order_type = 'target_rate' AS INTEGER)) AS tr
        FROM wins GROUP BY user_id""",
    "mart": f"""
        SELECT u.*, p.f AS first_successful_transaction_at, p.l AS last_successful_transaction_at,
               {rnd("(epoch_us(kyc_completed_at) - epoch_us(signup_timestamp)) / 864e8")} AS days_to_kyc,
               {rnd("(epoch_us(p.f) - epoch_us(signup_timestamp)) / 864e8")} AS activation_days_exact,
               {rnd("(epoch_us(p.f) - epoch_us(signup_timestamp)) / 36e8")} AS activation_hours,
               COALESCE(p.n, 0) AS successful_transaction_count,
               COALESCE(p.v, CAST(0 AS DOUBLE)) AS successful_transaction_volume,
               COALESCE(p.tr, 0) AS target_rate_user_flag,
               CASE WHEN u.user_id IN (SELECT user_id FROM app_events WHERE event_name = 'rate_alert_created')
                    THEN 1 ELSE 0 END AS rate_alert_user_flag,
               CASE WHEN p.f IS NOT NULL AND kyc_completed_at IS NULL THEN 0 ELSE 1 END AS onboarding_valid_flag,
               CASE WHEN kyc_completed_at IS NOT NULL AND bank_account_linked_at IS NOT NULL
                     AND date_trunc('second', p.f) <= date_trunc('second', signup_timestamp) + INTERVAL 14 DAY
                    THEN 1 ELSE 0 END AS activation_flag
        FROM app_users u LEFT JOIN per_user p ON p.user_id = u.user_id""",
    "valid": "SELECT * FROM mart WHERE onboarding_valid_flag = 1",
    "repeats": """
        SELECT p.user_id,
               CASE WHEN EXISTS (SELECT 1 FROM wins w WHERE w.user_id = p.user_id
                                 AND date_trunc('second', w.transaction_timestamp) > date_trunc('second', p.f)
                                 AND date_trunc('second', w.transaction_timestamp)
                                     <= date_trunc('second', p.f) + INTERVAL 30 DAY)
                    THEN 1 ELSE 0 END AS d30_repeat_flag
        FROM per_user p""",
    "firsts": """
        SELECT v.*, r.d30_repeat_flag FROM valid v JOIN repeats r ON r.user_id = v.user_id
        WHERE v.first_successful_transaction_at IS NOT NULL""",
    "ends": """
        SELECT CAST(last_day(CAST(m AS DATE)) AS DATE) AS obs
        FROM (SELECT unnest(generate_series(
                  (SELECT date_trunc('month', MIN(transaction_timestamp)) FROM wins),
                  (SELECT date_trunc('month', MAX(transaction_timestamp)) FROM wins), INTERVAL 1 MONTH)) AS m)
        WHERE last_day(CAST(m AS DATE))
              <= (SELECT CAST(MAX(transaction_timestamp) AS DATE) - 30 FROM wins)""",
    "spine": "SELECT p.user_id, e.obs FROM per_user p JOIN ends e ON e.obs >= CAST(p.f AS DATE)",
    "snaps": f"""
        SELECT s.user_id, s.obs AS observation_date,
               CAST(s.obs - MAX(CASE WHEN d <= s.obs AND ok THEN d END) AS INTEGER) AS recency_days,
               COUNT(*) FILTER (WHERE ok AND d <= s.obs AND d > s.obs - 90) AS transactions_90d,
               COUNT(*) FILTER (WHERE ok AND d <= s.obs) AS transactions_all,
               COALESCE({money("transaction_amount_krw",
                               " FILTER (WHERE ok AND d <= s.obs AND d > s.obs - 90)")}, CAST(0 AS DOUBLE))
                   AS total_volume_90d,
               COALESCE(CAST(COUNT(*) FILTER (WHERE NOT ok AND d <= s.obs AND d > s.obs - 90) AS DOUBLE)
                        / NULLIF(COUNT(*) FILTER (WHERE d <= s.obs AND d > s.obs - 90), 0), CAST(0 AS DOUBLE))
                   AS failed_ratio_90d,
               MAX(CASE WHEN ok AND d > s.obs AND d <= s.obs + 30 THEN 1 ELSE 0 END) AS target_repeat_30d
        FROM spine s
        JOIN (SELECT user_id, CAST(transaction_timestamp AS DATE) AS d, transaction_status = 'completed' AS ok,
                     transaction_amount_krw FROM tries) t ON t.user_id = s.user_id
        GROUP BY s.user_id, s.obs""",
    "newest": "SELECT * FROM snaps WHERE observation_date = (SELECT MAX(observation_date) FROM snaps)",
    "scored": """
        SELECT *, CAST((user_id * 37 + recency_days * 11) % 101 AS DOUBLE) / 100 AS repeat_probability,
               CASE WHEN (user_id * 37 + recency_days * 11) % 101 >= 50 THEN 1 ELSE 0 END AS predicted_repeat_30d
        FROM snaps""",
    "fresh": "SELECT * FROM scored WHERE observation_date = (SELECT MAX(observation_date) FROM snaps)",
    "rich": """
        SELECT f.*, m.acquisition_channel, m.successful_transaction_count, m.successful_transaction_volume,
               m.target_rate_user_flag, m.rate_alert_user_flag,
               total_volume_90d * CAST(0.00025 AS DOUBLE) AS estimated_fee_proxy_90d
        FROM fresh f LEFT JOIN mart m ON m.user_id = f.user_id""",
    "target_a": """
        SELECT *,
               CASE WHEN value_segment = 'High value' AND repeat_probability < 0.50 THEN 'High-value at-risk users'
                    WHEN transactions_90d = 0 THEN 'No recent transaction users'
                    WHEN failed_ratio_90d >= 0.20 THEN 'High failed transaction users'
                    WHEN repeat_probability < 0.35 THEN 'Low repeat probability users'
                    ELSE probability_segment || ' users' END AS risk_segment,
               CASE WHEN value_segment = 'High value' AND repeat_probability < 0.50 THEN 'Prioritize service recovery'
                    WHEN transactions_90d = 0 THEN 'Send reactivation education'
                    WHEN failed_ratio_90d >= 0.20 THEN 'Resolve transaction friction'
                    WHEN repeat_probability < 0.35 THEN 'Test feature onboarding prompt'
                    ELSE 'Maintain engagement' END AS recommended_action,
               CASE WHEN value_segment = 'High value' AND repeat_probability < 0.50
                    THEN 'High recent value but below-median repeat likelihood.'
                    WHEN transactions_90d = 0 THEN 'No transaction in the 90-day observation window.'
                    WHEN failed_ratio_90d >= 0.20 THEN 'At least 20% of recent transaction attempts failed.'
                    WHEN repeat_probability < 0.35
                    THEN 'Low repeat likelihood and suitable for a controlled test.'
                    ELSE 'No immediate risk rule was triggered.' END AS recommendation_reason
        FROM (SELECT *,
                     CASE WHEN total_volume_90d >= (SELECT quantile_cont(total_volume_90d, 0.75) FROM rich
                                                    WHERE total_volume_90d > 0)
                          THEN 'High value' ELSE 'Standard value' END AS value_segment,
                     CASE WHEN repeat_probability <= 0.35 THEN 'Low repeat probability'
                          WHEN repeat_probability <= 0.70 THEN 'Medium repeat probability'
                          ELSE 'High repeat probability' END AS probability_segment
              FROM rich)""",
    "target_b": """
        SELECT *,
               CASE WHEN value_segment = 'High value' AND repeat_probability < 0.50 THEN 'High-value at-risk users'
                    WHEN transactions_90d = 0 THEN 'No recent transaction users'
                    WHEN failed_ratio_90d >= 0.15 THEN 'High failed-ratio users'
                    ELSE probability_segment || ' users' END AS risk_segment,
               CASE WHEN value_segment = 'High value' AND repeat_probability < 0.50 THEN 'Priority retention outreach'
                    WHEN failed_ratio_90d >= 0.15 THEN 'Reliability support message'
                    WHEN repeat_probability < 0.35 AND transactions_90d = 0 THEN 'Reactivation education campaign'
                    WHEN repeat_probability < 0.35 THEN 'Reactivation offer'
                    WHEN repeat_probability < 0.70 AND target_rate_user_flag + rate_alert_user_flag = 0 THEN 'Rate-alert prompt'
                    WHEN repeat_probability < 0.70 AND rate_alert_user_flag = 0 THEN 'Promote rate-alert adoption'
                    WHEN repeat_probability >= 0.70 AND target_rate_user_flag = 0 THEN 'Target-rate upsell'
                    ELSE 'Maintain engagement' END AS recommended_action,
               CASE WHEN value_segment = 'High value' AND repeat_probability < 0.50 THEN 'High recent volume but repeat probability is below 50%.'
                    WHEN failed_ratio_90d >= 0.15 THEN 'Recent failed transaction ratio is elevated.'
                    WHEN repeat_probability < 0.35 AND transactions_90d = 0 THEN 'Low repeat probability and no transaction activity in the last 90 days.'
                    WHEN repeat_probability < 0.35 THEN 'Low repeat probability despite some historical product activity.'
                    WHEN repeat_probability < 0.70 AND target_rate_user_flag + rate_alert_user_flag = 0 THEN 'Medium repeat probability and no target-rate or rate-alert adoption yet.'
                    WHEN repeat_probability < 0.70 AND rate_alert_user_flag = 0 THEN 'Medium repeat probability and rate-alert feature has not been adopted.'
                    WHEN repeat_probability >= 0.70 AND target_rate_user_flag = 0 THEN 'High repeat probability and target-rate feature has not been adopted.'
                    ELSE 'User already has strong repeat probability or feature engagement.' END AS recommendation_reason
        FROM (SELECT *,
                      CASE WHEN total_volume_90d >= (SELECT quantile_cont(total_volume_90d, 0.75) FROM rich)
                           THEN 'High value' WHEN total_volume_90d > 0 THEN 'Active value'
                           ELSE 'No recent value' END AS value_segment,
                      CASE WHEN repeat_probability < 0.35 THEN 'Low repeat probability'
                           WHEN repeat_probability < 0.70 THEN 'Medium repeat probability'
                           ELSE 'High repeat probability' END AS probability_segment
              FROM rich)""",
    "trial": """
        SELECT user_id, acquisition_channel,
               CASE WHEN successful_transaction_volume >= 10000000 THEN 'High value' ELSE 'Standard value' END
                   AS value_segment,
               CASE WHEN CAST('0x' || substr(md5('spring:' || CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT) < 2147483648
                    THEN 'control' ELSE 'treatment' END AS variant,
               GREATEST(rate_alert_user_flag, target_rate_user_flag) AS feature_adoption_7d,
               activation_flag AS first_exchange_14d,
               CASE WHEN user_id IN (SELECT user_id FROM app_tickets) THEN 1 ELSE 0 END AS guardrail_event_30d
        FROM valid""",
}


def with_tables(sql: str) -> str:
    """Put the tables a statement names, and the ones those name, in front of it; those named more than once are worked out once."""
    wanted, text = [], sql
    for name, body in reversed(TABLES.items()):
        if re.search(rf"\b{name}\b", text):
            often = len(re.findall(rf"\b{name}\b", text)) > 1
            wanted.append(f"{name} AS {'MATERIALIZED ' if often else ''}({body})")
            text += body
    if not wanted:
        return sql
    head = ",\n".join(reversed(wanted))
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"

"""Funnels, retention, adoption, regimes, value and support reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.numeric import round_half_up
from tidemark.operators import funnel, overview, regimes, repeat, retention, snapshots, targeting, value
from tidemark.plans.catalogue import EXPORTS, Inputs
from tidemark.registry.base import money, money_avg, pct, query, rnd

_STAGES = {
    "kyc_completed": "COUNT(kyc_completed_at)",
    "bank_linked": "COUNT(bank_account_linked_at)",
    "first_successful_exchange": "COUNT(first_successful_transaction_at)",
    "activated_within_14_days": "CAST(SUM(activation_flag) AS BIGINT)",
}
_WIDE = "COUNT(*) AS valid_signups, " + ", ".join(f"{e} AS {n}" for n, e in _STAGES.items())
_RATES = ", ".join(
    f"{pct(_STAGES[s.name], 'COUNT(*)')} AS {s.rate}" for s in funnel.STAGES
)
_FUNNEL = f"SELECT {_WIDE} FROM valid"
_CHANNEL = f"SELECT acquisition_channel, {_WIDE}, {_RATES} FROM valid GROUP BY acquisition_channel"
_RATE = f"""COUNT(*) AS first_exchange_users, CAST(SUM(d30_repeat_flag) AS BIGINT) AS d30_repeat_users,
            {pct("SUM(d30_repeat_flag)", "COUNT(*)")} AS d30_repeat_rate"""
_BY_CHANNEL = f"SELECT acquisition_channel, {_RATE} FROM firsts GROUP BY acquisition_channel"
_LONG = " UNION ALL ".join(
    f"SELECT {i} AS stage_no, '{label}' AS stage, {name} AS users FROM fun"
    for i, (name, label) in enumerate(
        [("valid_signups", "Valid signup"), *[(s.name, s.label) for s in funnel.STAGES]], start=1
    )
)


@query("a1_funnel", _FUNNEL)
def a1(t):
    return funnel.funnel(t.mart)


@query("a2_funnel_by_channel", _CHANNEL)
def a2(t):
    return funnel.funnel(t.mart, by=["acquisition_channel"])


@query("a3_funnel_long", f"WITH fun AS ({_FUNNEL}) {_LONG}")
def a3(t):
    return funnel.funnel_long(funnel.funnel(t.mart))


@query(
    "a4_stage_rate",
    f"""WITH fun AS ({_FUNNEL}), lng AS ({_LONG})
        SELECT *, {pct("users", "(SELECT valid_signups FROM fun)")} AS conversion_from_start FROM lng""",
)
def a4(t):
    return funnel.stage_rate(funnel.funnel_long(funnel.funnel(t.mart)))


@query(
    "a5_prev_step_rate",
    f"""WITH fun AS ({_FUNNEL}), lng AS ({_LONG})
        SELECT a.*, {pct("a.users", "b.users")} AS conversion_from_previous
        FROM lng a LEFT JOIN lng b ON b.stage_no = a.stage_no - 1""",
)
def a5(t):
    return funnel.prev_step_rate(funnel.funnel_long(funnel.funnel(t.mart)))


@query(
    "a6_monthly_trend",
    f"""SELECT strftime(signup_timestamp, '%Y-%m') AS signup_month, COUNT(*) AS valid_signups,
               {_STAGES["kyc_completed"]} AS kyc_completed,
               {_STAGES["first_successful_exchange"]} AS first_successful_exchange,
               {_STAGES["activated_within_14_days"]} AS activated_within_14_days,
               {pct("SUM(activation_flag)", "COUNT(*)")} AS activation_rate_14d FROM valid GROUP BY 1""",
)
def a6(t):
    return funnel.monthly_trend(t.mart)


@query("a7_d30_by_channel", _BY_CHANNEL)
def a7(t):
    return repeat.repeat_rate(t.mart, t.repeat)


@query("a7b_overall_rate", f"SELECT {pct('SUM(d30_repeat_flag)', 'COUNT(*)')} AS d30_repeat_rate FROM firsts")
def a7b(t):
    by_channel = repeat.repeat_rate(t.mart, t.repeat)
    return repeat.overall_rate(by_channel, "d30_repeat_users", "first_exchange_users", "d30_repeat_rate")


@query(
    "a8_feature_adoption",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS feature, CAST(SUM({c}) AS BIGINT) AS adopted_users, COUNT(*) AS eligible_users,
                   {pct(f"SUM({c})", "COUNT(*)")} AS adoption_rate FROM valid"""
        for n, c in funnel.FEATURE_FLAGS.items()
    ),
)
def a8(t):
    return funnel.feature_adoption(t.mart)


@query(
    "a9_feature_retention",
    " UNION ALL ".join(
        f"""SELECT '{kind}' AS comparison_type,
                   CASE WHEN {flag} = 1 THEN '{yes}' ELSE '{no}' END AS user_group, {_RATE} FROM firsts GROUP BY 1, 2"""
        for kind, (flag, yes, no) in repeat.FEATURE_COMPARISONS.items()
    ),
)
def a9(t):
    return repeat.feature_retention(t.mart, t.repeat)


@query(
    "a10_feature_combo",
    f"""SELECT ['Neither feature', 'Rate-alert only', 'Target-rate only', 'Both target-rate and rate-alert']
                   [1 + rate_alert_user_flag + 2 * target_rate_user_flag] AS feature_group, {_RATE}
        FROM firsts GROUP BY 1""",
)
def a10(t):
    return repeat.feature_combo(t.mart, t.repeat)


_BEHAVIOR = f"""SELECT market_regime_at_transaction, COUNT(*) AS transaction_attempts,
        COUNT(*) FILTER (WHERE NOT failed) AS successful_transactions,
        {pct("COUNT(*) FILTER (WHERE NOT failed)", "COUNT(*)")} AS success_rate,
        {rnd(money_avg("amount"), 0)} AS avg_transaction_amount_krw,
        {rnd(money("CASE WHEN failed THEN 0 ELSE amount END"), 0)} AS completed_volume_krw
    FROM tries GROUP BY 1"""
_ACTIVITY = f"""SELECT a.market_regime_at_transaction AS market_regime, h.regime_hour_rows, a.transaction_attempts,
        a.successful_transactions,
        {rnd("CAST(a.transaction_attempts AS DOUBLE) / h.regime_hour_rows")} AS attempts_per_regime_hour,
        {rnd("CAST(a.successful_transactions AS DOUBLE) / h.regime_hour_rows")}
            AS successful_transactions_per_regime_hour
    FROM ({_BEHAVIOR}) a JOIN (SELECT market_regime, COUNT(*) AS regime_hour_rows FROM app_rates GROUP BY 1) h
      ON h.market_regime = a.market_regime_at_transaction"""


@query("a11_regime_behavior", _BEHAVIOR)
def a11(t):
    return regimes.regime_behavior(t.tx)


@query("a12_regime_activity", _ACTIVITY)
def a12(t):
    return regimes.regime_activity(t.tx, t.rates)


@query(
    "a13_failure_share",
    f"""SELECT *, {pct("failed_transactions", "SUM(failed_transactions) OVER (PARTITION BY market_regime_at_transaction)")}
               AS share_within_regime
        FROM (SELECT market_regime_at_transaction, failure_reason, COUNT(*) AS failed_transactions
              FROM tries WHERE failed GROUP BY ALL)""",
)
def a13(t):
    return regimes.failure_share(t.tx)


def _cohort_sql(source: str, extra: str = "") -> str:
    return f"""
      SELECT CAST(CAST(date_trunc('month', p.f) AS DATE) AS VARCHAR) AS cohort_month,
             date_diff('month', date_trunc('month', p.f), date_trunc('month', w.transaction_timestamp))
                 AS months_since_first_transaction,
             COUNT(DISTINCT w.user_id) AS retained_users, c.cohort_users,
             {pct("COUNT(DISTINCT w.user_id)", "c.cohort_users")} AS retention_rate
      FROM wins w JOIN per_user p ON p.user_id = w.user_id
      JOIN (SELECT date_trunc('month', f) AS m, COUNT(*) AS cohort_users FROM per_user p
            WHERE user_id IN (SELECT user_id FROM {source}) GROUP BY 1) c ON c.m = date_trunc('month', p.f)
      WHERE w.user_id IN (SELECT user_id FROM {source}) GROUP BY 1, 2, c.cohort_users {extra}"""


@query("a14_cohort_retention", _cohort_sql("valid", "HAVING months_since_first_transaction BETWEEN 0 AND 6"))
def a14(t):
    return retention.cohort_retention(t.tx, t.mart, 6)


@query("a14b_cohort_retention_all", _cohort_sql("per_user"))
def a14b(t):
    return retention.cohort_retention(t.tx)


@query(
    "a14c_weighted_retention",
    f"""SELECT months_since_first_transaction, CAST(SUM(retained_users) AS BIGINT) AS retained_users,
               CAST(SUM(cohort_users) AS BIGINT) AS cohort_users,
               {pct("SUM(retained_users)", "SUM(cohort_users)")} AS weighted_retention_rate
        FROM ({_cohort_sql("per_user")}) GROUP BY 1""",
)
def a14c(t):
    return retention.weighted_retention(retention.cohort_retention(t.tx))


@query(
    "a14d_cohort_matrix",
    "SELECT cohort_month, "
    + ", ".join(
        f"MAX(retention_rate) FILTER (WHERE months_since_first_transaction = {i}) AS m{i}" for i in range(1, 7)
    )
    + f""" FROM ({_cohort_sql("per_user")}) WHERE months_since_first_transaction BETWEEN 1 AND 6
        GROUP BY cohort_month ORDER BY cohort_month DESC LIMIT 12""",
)
def a14d(t):
    return retention.cohort_matrix(retention.cohort_retention(t.tx))


@query(
    "a15_value_segments",
    f"""SELECT ['Q1 lowest volume', 'Q2', 'Q3', 'Q4 highest volume'][q] AS value_segment, COUNT(*) AS users,
               {rnd("AVG(n)")} AS avg_successful_transactions, {rnd(money_avg("v"), 0)} AS avg_total_volume_krw,
               {rnd(money_avg("fee"), 0)} AS avg_total_fee_krw,
               {pct("SUM(target_rate_user_flag)", "COUNT(*)")} AS target_rate_adoption_rate,
               {pct("SUM(rate_alert_user_flag)", "COUNT(*)")} AS rate_alert_adoption_rate
        FROM (SELECT p.*, m.target_rate_user_flag, m.rate_alert_user_flag,
                     NTILE(4) OVER (ORDER BY p.v, p.user_id) AS q
              FROM per_user p JOIN valid m ON m.user_id = p.user_id) GROUP BY q""",
)
def a15(t):
    return value.value_segments(t.mart, t.tx)


@query(
    "a16_support_impact",
    f"""SELECT CASE WHEN s.user_id IS NULL THEN 'No support ticket' WHEN s.n = 1 THEN 'One support ticket'
                    ELSE 'Multiple support tickets' END AS support_group, {_RATE},
               {rnd("AVG(s.h)")} AS avg_resolution_time_hours, {rnd("AVG(s.c)")} AS avg_satisfaction_score
        FROM firsts f LEFT JOIN (SELECT user_id, COUNT(*) AS n, AVG(resolution_time_hours) AS h,
                                        AVG(satisfaction_score) AS c FROM app_tickets GROUP BY user_id) s
          ON s.user_id = f.user_id GROUP BY 1""",
)
def a16(t):
    return repeat.support_impact(t.mart, t.repeat, t.tickets)


@query("s8_catalogue_entry", f"SELECT {_WIDE} FROM valid")
def s8(t):
    """An extract by its catalogue name."""
    return EXPORTS["product_funnel"](Inputs(t.mart, t.tx, t.repeat, t.rates, t.tickets, t.tx))


@query(
    "a17_snapshot_profile",
    f"""SELECT COUNT(*) AS snapshot_rows, COUNT(DISTINCT user_id) AS users,
               CAST(MIN(observation_date) AS VARCHAR) AS min_observation_date,
               CAST(MAX(observation_date) AS VARCHAR) AS max_observation_date,
               CAST(SUM(target_repeat_30d) AS BIGINT) AS positive_targets,
               {pct("SUM(target_repeat_30d)", "COUNT(*)")} AS positive_target_rate,
               {rnd("AVG(recency_days)")} AS avg_recency_days, {rnd("AVG(transactions_90d)")} AS avg_transactions_90d,
               {rnd(money_avg("failed_ratio_90d"), 4)} AS avg_failed_ratio_90d FROM snaps""",
)
def a17(t):
    return snapshots.snapshot_profile(t.snapshots)


@query(
    "a18_lifecycle_summary",
    f"""SELECT COUNT(*) AS users, CAST(SUM(onboarding_valid_flag) AS BIGINT) AS valid_onboarding_users,
               CAST(SUM(activation_flag) AS BIGINT) AS activated_within_14_days,
               {pct("SUM(activation_flag)", "SUM(onboarding_valid_flag)")} AS activation_rate_14d,
               {rnd("AVG(activation_days_exact)")} AS avg_activation_days,
               CAST(SUM(target_rate_user_flag) AS BIGINT) AS target_rate_users,
               CAST(SUM(rate_alert_user_flag) AS BIGINT) AS rate_alert_users FROM valid""",
)
def a18(t):
    return funnel.lifecycle_summary(t.mart)


@query(
    "a19_channel_quality",
    f"SELECT * FROM ({_CHANNEL}) LEFT JOIN ({_BY_CHANNEL}) USING (acquisition_channel)",
)
def a19(t):
    return funnel.channel_quality(
        funnel.funnel(t.mart, by=["acquisition_channel"]), repeat.repeat_rate(t.mart, t.repeat)
    )


@query(
    "a20_regime_overview",
    f"""SELECT a.*, b.success_rate FROM ({_ACTIVITY}) a
        LEFT JOIN ({_BEHAVIOR}) b ON b.market_regime_at_transaction = a.market_regime""",
)
def a20(t):
    return regimes.regime_overview(regimes.regime_activity(t.tx, t.rates), regimes.regime_behavior(t.tx))


_MEAN_P = f"{rnd(money_avg('repeat_probability'), 10)} AS average_repeat_probability"


@query(
    "a21_targeting_summary",
    f"SELECT risk_segment, recommended_action, COUNT(*) AS users, {_MEAN_P} FROM target_a GROUP BY 1, 2",
)
def a21(t):
    return targeting.targeting_summary(t.targeting("A"))


@query(
    "a22_audience_summary",
    f"""SELECT risk_segment, COUNT(*) AS users, {_MEAN_P}, {rnd(money("total_volume_90d"))} AS recent_volume_krw
        FROM target_a GROUP BY 1""",
)
def a22(t):
    summary = targeting.audience_summary(t.targeting("A"))
    return summary.withColumn("recent_volume_krw", round_half_up("recent_volume_krw", 2))


@query(
    "a23_priority_audience",
    "SELECT COUNT(*) AS priority_audience FROM target_b WHERE risk_segment <> 'High repeat probability users'",
)
def a23(t):
    return targeting.priority_audience(t.targeting("B"))


@query(
    "a24_monthly_profile",
    f"""SELECT strftime(observation_date, '%Y-%m') AS observation_month, COUNT(*) AS rows,
               COUNT(DISTINCT user_id) AS users, AVG(target_repeat_30d) AS positive_rate FROM snaps GROUP BY 1""",
)
def a24(t):
    return snapshots.monthly_profile(t.snapshots)


@query(
    "a25_target_balance",
    """SELECT target_repeat_30d, COUNT(*) AS rows,
              CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM snaps) AS share FROM snaps GROUP BY 1""",
)
def a25(t):
    return overview.balance(t.snapshots, "target_repeat_30d")


@query(
    "a18b_activation_share",
    "SELECT CAST(SUM(activation_flag) AS DOUBLE) / COUNT(*) AS activation_share FROM valid",
)
def a18b(t):
    return funnel.activation_ratio(funnel.funnel(t.mart))

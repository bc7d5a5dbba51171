"""Targeting, scenarios and experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.numeric import round_half_up
from tidemark.operators import experiment, quality, ranking, scenario, targeting
from tidemark.registry.base import money, query, rnd, signed_rnd
from tidemark.sources.stand_in import PAIRS

_T_COLUMNS = ", ".join(
    f"CAST({c} AS VARCHAR) AS {c}" if c == "observation_date" else c for c in targeting.TARGETING_COLUMNS
)


@query("t1_targeting_a", f"SELECT {_T_COLUMNS} FROM target_a")
def t1(t):
    return t.targeting("A")


@query("t2_targeting_b", f"SELECT {_T_COLUMNS} FROM target_b")
def t2(t):
    return t.targeting("B").orderBy(F.desc("repeat_probability"), F.desc("total_volume_90d"))


@query(
    "t3_ntile",
    "SELECT user_id, CAST(NTILE(10) OVER (ORDER BY v, user_id) AS INTEGER) AS decile FROM per_user",
)
def t3(t):
    from tidemark.operators.lifecycle import success_summary

    base = success_summary(t.tx).select("user_id", "successful_transaction_volume")
    return ranking.ntile_scalable(base, "successful_transaction_volume", "user_id", 10, "decile").select("user_id", "decile")


@query(
    "t4_fee_proxy",
    f"""SELECT user_id, CAST(observation_date AS VARCHAR) AS observation_date,
               total_volume_90d * CAST(0.00025 AS DOUBLE) AS fee FROM snaps""",
)
def t4(t):
    return t.snapshots.select("user_id", "observation_date", targeting.fee_proxy().alias("fee"))


@query(
    "t5_high_value",
    """SELECT user_id, total_volume_90d,
              CASE WHEN total_volume_90d >= (SELECT quantile_cont(total_volume_90d, 0.75) FROM newest
                                             WHERE total_volume_90d > 0)
                   THEN 'High value' ELSE 'Standard value' END AS value_segment FROM newest""",
)
def t5(t):
    from tidemark.operators.snapshots import latest

    newest = latest(t.snapshot_table)
    cut = targeting.high_value_threshold(newest)
    return newest.select("user_id", "total_volume_90d", targeting.value_segment(cut).alias("value_segment"))


_GRID = f"""
    SELECT a.n AS audience_users, {rnd("a.p", 6)} AS baseline_expected_repeat_users, u.k AS uplift_scenario,
           u.v AS absolute_uplift_assumption, {rnd("a.n * u.v", 6)} AS incremental_repeat_users,
           {rnd("a.m", 6)} AS median_recent_volume_proxy_krw, {rnd("a.n * u.v * a.m", 4)} AS incremental_volume_proxy_krw,
           f.k AS fee_proxy_scenario, f.v AS fee_proxy_rate_assumption,
           {rnd("a.n * u.v * a.m * f.v", 4)} AS value_impact_proxy_krw, '{scenario.NOTE}' AS assumption_note
    FROM (SELECT COUNT(*) AS n, {money("repeat_probability")} AS p,
                 quantile_cont(total_volume_90d, 0.5) FILTER (WHERE total_volume_90d > 0) AS m FROM target_a
          WHERE risk_segment <> 'High repeat probability users') a,
         (VALUES ('low', CAST(0.02 AS DOUBLE)), ('base', CAST(0.05 AS DOUBLE)), ('high', CAST(0.08 AS DOUBLE))) u(k, v),
         (VALUES ('low', CAST(0.00015 AS DOUBLE)), ('base', CAST(0.00025 AS DOUBLE)),
                 ('high', CAST(0.00035 AS DOUBLE))) f(k, v)"""


def _grid(t):
    audience = targeting.campaign_audience(t.targeting("A"))
    grid = scenario.scenario_grid(scenario.audience_totals(audience))
    return grid.withColumns(
        {
            "baseline_expected_repeat_users": round_half_up("baseline_expected_repeat_users", 6),
            "incremental_repeat_users": round_half_up("incremental_repeat_users", 6),
            "median_recent_volume_proxy_krw": round_half_up("median_recent_volume_proxy_krw", 6),
            "incremental_volume_proxy_krw": round_half_up("incremental_volume_proxy_krw", 4),
            "value_impact_proxy_krw": round_half_up("value_impact_proxy_krw", 4),
        }
    )


@query("t6_scenario_grid", _GRID)
def t6(t):
    return _grid(t)


@query(
    "t6b_base_scenario",
    f"SELECT * FROM ({_GRID}) WHERE uplift_scenario = 'base' AND fee_proxy_scenario = 'base'",
)
def t6b(t):
    return scenario.base_scenario(_grid(t))


@query(
    "j11_grid",
    """SELECT n AS audience_users, u.k AS uplift_scenario, f.k AS fee_proxy_scenario,
              CAST(n AS DOUBLE) * u.v AS incremental_repeat_users
       FROM (SELECT COUNT(*) AS n FROM app_users GROUP BY acquisition_channel),
            (VALUES ('low', 0.02::DOUBLE), ('base', 0.05::DOUBLE), ('high', 0.08::DOUBLE)) u(k, v),
            (VALUES ('low'), ('base'), ('high')) f(k)""",
)
def j11(t):
    """The grid of the scenario operator over one totals row for each channel."""
    totals = t.users.groupBy("acquisition_channel").agg(F.count(F.lit(1)).alias("audience_users"))
    nothing = {"baseline_expected_repeat_users": F.lit(0.0), "median_recent_volume_proxy_krw": F.lit(0.0)}
    grid = scenario.scenario_grid(totals.withColumns(nothing))
    return grid.select("audience_users", "uplift_scenario", "fee_proxy_scenario", "incremental_repeat_users")


@query(
    "t7_assign_variant",
    """SELECT user_id,
              CASE WHEN CAST('0x' || substr(md5('autumn:' || CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT)
                        < CAST(4294967296 * 0.9 AS BIGINT) THEN 'control' ELSE 'treatment' END AS variant
       FROM app_users""",
)
def t7(t):
    ids = t.users.select("user_id")
    return experiment.assign_variant(ids, "user_id", "autumn", {"control": 0.9, "treatment": 0.1})


def _stats(source: str, keys: str) -> str:
    """The test written out in SQL, the normal tail by Simpson's rule."""
    return f"""
      SELECT {keys} control_n, treatment_n, {rnd("cr", 10)} AS control_rate, {rnd("tr", 10)} AS treatment_rate,
             {signed_rnd("tr - cr", 10)} AS absolute_uplift,
             CASE WHEN cr > 0 THEN {signed_rnd("(tr - cr) / cr", 8)} END AS relative_uplift,
             {signed_rnd("tr - cr - 1.96 * se", 8)} AS ci_95_low, {signed_rnd("tr - cr + 1.96 * se", 8)} AS ci_95_high,
             {signed_rnd("z", 8)} AS z_statistic,
             {rnd("greatest(1 - 2 * area / sqrt(2 * pi()), 0)", 6)} AS p_value,
             1 - 2 * area / sqrt(2 * pi()) < 0.05 AS statistically_significant_5pct
      FROM (SELECT *, (abs(z) / 6000) * list_sum(list_transform(range(0, 2001), lambda i:
                      (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
                      * exp(-power(i * abs(z) / 2000, 2) / 2))) AS area
            FROM (SELECT *, (tr - cr) / sqrt(greatest(pr * (1 - pr) * (1.0 / control_n + 1.0 / treatment_n), 1e-12)) AS z,
                         sqrt(greatest(cr * (1 - cr) / control_n + tr * (1 - tr) / treatment_n, 1e-12)) AS se
                  FROM (SELECT *, CAST(ch AS DOUBLE) / control_n AS cr, CAST(th AS DOUBLE) / treatment_n AS tr,
                               CAST(ch + th AS DOUBLE) / (control_n + treatment_n) AS pr FROM ({source}))))"""


_ARMS = """COUNT(*) FILTER (WHERE variant = 'control') AS control_n,
           COUNT(*) FILTER (WHERE variant = 'treatment') AS treatment_n,
           SUM({m}) FILTER (WHERE variant = 'control') AS ch, SUM({m}) FILTER (WHERE variant = 'treatment') AS th"""
_METRICS = " UNION ALL ".join(
    f"SELECT '{m}' AS metric, '{r}' AS metric_role, {_ARMS.format(m=m)} FROM trial"
    for m, r in experiment.METRIC_ROLES.items()
)


def _rounded(df):
    digits = {
        "control_rate": 10,
        "treatment_rate": 10,
        "absolute_uplift": 10,
        "relative_uplift": 8,
        "ci_95_low": 8,
        "ci_95_high": 8,
        "z_statistic": 8,
        "p_value": 6,
    }
    return df.withColumns({c: round_half_up(c, n) for c, n in digits.items()})


@query("t8_ab_test", _stats(_METRICS, "metric,"))
def t8(t):
    return _rounded(experiment.ab_test(t.trial, list(experiment.METRIC_ROLES)))


@query(
    "t9_ab_results",
    f"""SELECT *, abs(absolute_uplift) >= CASE metric_role WHEN 'primary' THEN 0.02 ELSE 0.01 END
               AS practically_significant, 'observed' AS data_source FROM ({_stats(_METRICS, "metric, metric_role,")})""",
)
def t9(t):
    return _rounded(experiment.ab_results(t.trial))


_SEGMENTS = " UNION ALL ".join(
    f"""SELECT '{d}' AS segment_type, {d} AS segment, 'feature_adoption_7d' AS metric,
               {_ARMS.format(m="feature_adoption_7d")} FROM trial GROUP BY {d}"""
    for d in ("acquisition_channel", "value_segment")
)


@query(
    "t10_ab_segments",
    f"""SELECT *, 'observed' AS data_source
        FROM ({_stats(f"SELECT * FROM ({_SEGMENTS}) WHERE least(control_n, treatment_n) >= 100",
                      "segment_type, segment, metric,")})""",
)
def t10(t):
    return _rounded(experiment.ab_segments(t.trial))


@query(
    "t11_lifetime_segment",
    """SELECT user_id, CASE WHEN successful_transaction_volume >= 10000000 THEN 'High value' ELSE 'Standard value' END
              AS value_segment FROM valid""",
)
def t11(t):
    return t.trial.select("user_id", "value_segment")


_ACTION = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in targeting.READINESS_ACTIONS.items())


@query(
    "t12_readiness",
    f"""SELECT transaction_id, market_regime_at_transaction,
               CASE market_regime_at_transaction {_ACTION} END AS recommended_action FROM app_tx""",
)
def t12(t):
    rows = t.tx.select("transaction_id", "market_regime_at_transaction")
    return targeting.readiness(rows, "market_regime_at_transaction")


@query(
    "t13_latest_signal",
    """SELECT pair, CAST("date" AS VARCHAR) AS "date", close FROM app_fx
       QUALIFY row_number() OVER (PARTITION BY pair ORDER BY "date" DESC) = 1""",
)
def t13(t):
    """The latest signal of every pair."""
    latest = [targeting.latest_signal(t.fx_daily.where(F.col("pair") == p)).select("pair", "date", "close") for p in PAIRS]
    return quality.union(latest)

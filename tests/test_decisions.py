"""Targeting rules, scenario grid and experiment evaluation, the latter two against published numbers."""

from __future__ import annotations

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tidemark.operators import experiment, scenario, targeting


def inputs(spark, people):
    """Rows of (user, probability, transactions, volume, failed ratio, target-rate, alert)."""
    score = spark.createDataFrame(
        [(u, "2024-01-31", 0, p, 0) for u, p, *_ in people],
        "user_id long, observation_date string, target_repeat_30d int, repeat_probability double, predicted_repeat_30d int",
    )
    snap = spark.createDataFrame(
        [(u, "2024-01-31", 3, n, n, v, r, 0) for u, _, n, v, r, *_ in people],
        "user_id long, observation_date string, recency_days int, transactions_90d long, transactions_all long, "
        "total_volume_90d double, failed_ratio_90d double, target_repeat_30d int",
    )
    context = spark.createDataFrame(
        [(u, "direct", 1, 1.0, t, a) for u, _, _, _, _, t, a in people],
        "user_id long, acquisition_channel string, successful_transaction_count long, "
        "successful_transaction_volume double, target_rate_user_flag int, rate_alert_user_flag int",
    )
    return score, snap, context


PEOPLE = [
    (1, 0.35, 5, 1000.0, 0.0, 0, 0),
    (2, 0.70, 0, 0.0, 0.0, 0, 1),
    (3, 0.90, 2, 10.0, 0.15, 1, 1),
    (4, 0.90, 2, 10.0, 0.20, 0, 1),
    (5, 0.10, 2, 10.0, 0.0, 1, 1),
    (6, 0.60, 2, 10.0, 0.0, 0, 0),
    (7, 0.95, 2, 10.0, 0.0, 1, 0),
]


def test_rule_set_a(spark):
    out = targeting.targeting(*inputs(spark, PEOPLE), rules="A", threshold=500.0)
    assert tuple(out.columns) == targeting.TARGETING_COLUMNS
    got = {r["user_id"]: (r["probability_segment"], r["risk_segment"], r["recommended_action"]) for r in out.collect()}
    assert got[1] == ("Low repeat probability", "High-value at-risk users", "Prioritize service recovery")
    assert got[2] == ("Medium repeat probability", "No recent transaction users", "Send reactivation education")
    assert got[3] == ("High repeat probability", "High repeat probability users", "Maintain engagement")
    assert got[4][1:] == ("High failed transaction users", "Resolve transaction friction")
    assert got[5][1:] == ("Low repeat probability users", "Test feature onboarding prompt")
    assert got[6][1:] == ("Medium repeat probability users", "Maintain engagement")


def test_rule_set_b(spark):
    out = targeting.targeting(*inputs(spark, PEOPLE), rules="B", threshold=500.0)
    got = {r["user_id"]: (r["probability_segment"], r["value_segment"], r["risk_segment"], r["recommended_action"]) for r in out.collect()}
    assert got[1] == ("Medium repeat probability", "High value", "High-value at-risk users", "Priority retention outreach")
    assert got[2] == ("High repeat probability", "No recent value", "No recent transaction users", "Target-rate upsell")
    assert got[3][2:] == ("High failed-ratio users", "Reliability support message")
    assert got[5][2:] == ("Low repeat probability users", "Reactivation offer")
    assert got[6][2:] == ("Medium repeat probability users", "Rate-alert prompt")
    assert got[7][1:] == ("Active value", "High repeat probability users", "Maintain engagement")


def test_thresholds_by_rule_set(spark):
    score, snap, context = inputs(spark, PEOPLE)
    assert targeting.high_value_threshold(snap) == 10.0
    assert targeting.high_value_threshold(snap, positive_only=False) == 10.0
    assert targeting.high_value_threshold(snap.where("user_id < 3"), positive_only=False) == 750.0
    out = targeting.targeting(score, snap, context, rules="A")
    assert out.where("value_segment = 'High value'").count() == 6


def test_duplicate_scores_are_refused(spark):
    score, snap, context = inputs(spark, PEOPLE)
    with pytest.raises(Exception, match="not unique"):
        targeting.targeting(score.unionByName(score), snap, context, threshold=1.0).collect()


def test_summaries(spark):
    out = targeting.targeting(*inputs(spark, PEOPLE), rules="B", threshold=500.0)
    assert sum(r["users"] for r in targeting.targeting_summary(out).collect()) == 7
    assert sum(r["recent_volume_krw"] for r in targeting.audience_summary(out).collect()) == 1050.0
    assert targeting.priority_audience(out).head()[0] == 6


def test_scenario_grid_against_published_numbers(spark):
    totals = spark.createDataFrame(
        [(18768, 8114.598887828064, 2323655.5)],
        "audience_users long, baseline_expected_repeat_users double, median_recent_volume_proxy_krw double",
    )
    grid = scenario.scenario_grid(totals)
    got = {(r["uplift_scenario"], r["fee_proxy_scenario"]): r for r in grid.collect()}
    assert len(got) == 9
    low, base, high = got[("low", "low")], got[("base", "base")], got[("high", "high")]
    assert low["value_impact_proxy_krw"] == pytest.approx(130831.09927199999, rel=1e-14)
    assert base["incremental_repeat_users"] == pytest.approx(938.4000000000001, rel=1e-14)
    assert base["incremental_volume_proxy_krw"] == pytest.approx(2180518321.2000003, rel=1e-14)
    assert base["value_impact_proxy_krw"] == pytest.approx(545129.5803, rel=1e-14)
    assert high["value_impact_proxy_krw"] == pytest.approx(1221090.259872, rel=1e-14)
    assert scenario.base_scenario(grid).count() == 1
    assert "Cartesian" not in grid._jdf.queryExecution().toString()


# Published test results: metric -> (n, hits) per arm and the statistics.
PUBLISHED = {
    "feature_adoption_7d": (22425, 4852, 22549, 5953, 0.04763717494115258, 0.22016975433951907,
                            0.03975372096661936, 0.055520628915685794, 11.823011315991328, 0.0, True, True),
    "first_exchange_14d": (22425, 4720, 22549, 5031, 0.012634731358978274, 0.06002835820446775,
                           0.005019082471859358, 0.02025038024609719, 3.2511640921055927, 0.0011493350130846736, True, True),
    "guardrail_event_30d": (22425, 1643, 22549, 1597, -0.0024429038546699283, -0.03334273824770124,
                            -0.007222341879784794, 0.002336534170444937, -1.0018425910182651, 0.31641962321997275, False, False),
}


def test_ab_results_against_published_numbers(spark):
    def flag(metric):
        c_n, c_hits, t_n, t_hits = PUBLISHED[metric][:4]
        in_control = F.col("id") < c_n
        return F.when(in_control, F.col("id") < c_hits).otherwise(F.col("id") - c_n < t_hits).cast("int").alias(metric)

    n = 22425 + 22549
    df = spark.range(n).select(
        F.when(F.col("id") < 22425, "control").otherwise("treatment").alias("variant"), *[flag(m) for m in PUBLISHED]
    )
    for r in experiment.ab_results(df, source="simulated").collect():
        c_n, _, t_n, _, up, rel, low, high, z, p, sig, practical = PUBLISHED[r["metric"]]
        assert (r["control_n"], r["treatment_n"]) == (c_n, t_n)
        for column, want in (("absolute_uplift", up), ("relative_uplift", rel), ("ci_95_low", low), ("ci_95_high", high), ("z_statistic", z)):
            assert r[column] == pytest.approx(want, rel=1e-9), column
        assert r["p_value"] == pytest.approx(p, abs=1e-12)
        assert (r["statistically_significant_5pct"], r["practically_significant"]) == (sig, practical)
        assert r["metric_role"] == experiment.METRIC_ROLES[r["metric"]]


def test_zero_control_rate(spark):
    df = spark.createDataFrame([("control", 0), ("control", 0), ("treatment", 1)], "variant string, m int")
    got = experiment.ab_test(df, ["m"]).head()
    assert got["relative_uplift"] is None and got["absolute_uplift"] == 1.0


@pytest.mark.parametrize("control,kept", [(99, 0), (100, 1)])
def test_small_arms_are_left_out(spark, control, kept):
    data = [("control", i % 2, "x") for i in range(control)] + [("treatment", 1, "x") for _ in range(150)]
    df = spark.createDataFrame(data, "variant string, feature_adoption_7d int, seg string")
    assert experiment.ab_segments(df, ["seg"]).count() == kept


def test_assignment_is_stable(spark):
    df = spark.range(2000).withColumnRenamed("id", "user_id")
    a = rows(experiment.assign_variant(df, "user_id", "x"))
    assert a == rows(experiment.assign_variant(df.repartition(9), "user_id", "x"))
    share = sum(v == "control" for _, v in a) / len(a)
    assert 0.45 < share < 0.55
    weighted = experiment.assign_variant(df, "user_id", "x", {"a": 8, "b": 1, "c": 1}).groupBy("variant").count()
    got = {r["variant"]: r["count"] for r in weighted.collect()}
    assert set(got) == {"a", "b", "c"} and got["a"] > 1500


def test_readiness(spark):
    df = spark.createDataFrame([("high",), ("other",)], "predicted_regime string")
    got = [r["recommended_action"] for r in targeting.readiness(df).collect()]
    assert got == [targeting.READINESS_ACTIONS["high"], None]

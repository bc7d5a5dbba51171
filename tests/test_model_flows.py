"""Flows from training tables to extracts, over small tables and quick candidates."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.models import estimators, repeat, volatility
from tidemark.operators import snapshots
from tidemark.plans import catalogue, model_flows
from tidemark.plans.staging import staged

CONTEXT = (
    "user_id long, acquisition_channel string, successful_transaction_count long, successful_transaction_volume double, "
    "target_rate_user_flag int, rate_alert_user_flag int"
)
QUICK = {
    "Logistic Regression": repeat.CANDIDATES["Logistic Regression"],
    "Random Forest": lambda: estimators.forest(snapshots.REPEAT_FEATURES, snapshots.TARGET, trees=4, depth=3, min_leaf=5),
}


@pytest.fixture(scope="module")
def flow(spark):
    """Users with odd ids come back, even ones don't, with some noise; volumes are tied, one user has no context."""
    rows = [
        (u, date(2024, m, 28), (u * 7 + m) % 40, u % 5, 9, 100.0 * (u % 3), 0.1 * (u % 2), int((u % 2 == 1) != ((u + m) % 9 == 0)))
        for u in range(60)
        for m in range(1, 11)
    ]
    snaps = staged(
        spark.createDataFrame(
            rows,
            "user_id long, observation_date date, recency_days int, transactions_90d long, transactions_all long, "
            "total_volume_90d double, failed_ratio_90d double, target_repeat_30d int",
        ),
        "flow-snapshots",
    )
    context = spark.createDataFrame([(u, None if u == 3 else "web", u, 1.0 * u, u % 2, 0) for u in range(59)], CONTEXT)
    return model_flows.repeat_flow(snaps, context, candidates=QUICK), rows


def test_champion_is_judged_on_the_test_part(flow):
    found, rows = flow
    matrix = {r["actual"]: (r["Predicted no repeat"], r["Predicted repeat"]) for r in found["user_repeat_confusion_matrix"].collect()}
    dates = sorted({r[1] for r in rows})
    held = [r for r in rows if r[1] >= dates[int(len(dates) * 0.85)]]
    assert sum(matrix["Actual repeat"]) == sum(r[-1] for r in held)
    assert sum(matrix["Actual no repeat"]) == sum(1 - r[-1] for r in held)
    report = {r["class"]: r for r in found["user_repeat_classification_report"].collect()}
    right = matrix["Actual repeat"][1] + matrix["Actual no repeat"][0]
    assert report["accuracy"]["recall"] == pytest.approx(right / len(held)) and right > 0.7 * len(held)
    metrics = found["user_repeat_model_metrics"].where("selected_model_flag = 1").collect()
    assert len(metrics) == 1 and metrics[0]["accuracy"] == pytest.approx(right / len(held))
    assert found["user_repeat_feature_importance"].count() == len(snapshots.REPEAT_FEATURES)


def test_targeting_follows_the_refitted_scores(flow):
    found, _ = flow
    scores = {r["user_id"]: r for r in found["user_repeat_predictions"].collect()}
    aimed = {r["user_id"]: r for r in found["user_repeat_targeting_dataset"].collect()}
    assert scores.keys() == aimed.keys() == set(range(60))
    assert all(aimed[u]["repeat_probability"] == scores[u]["repeat_probability"] for u in scores)
    assert aimed[59]["acquisition_channel"] is None and aimed[3]["acquisition_channel"] is None
    odd, even = ([s["repeat_probability"] for u, s in scores.items() if u % 2 == k] for k in (1, 0))
    assert min(sum(odd) / 30, 0.99) > sum(even) / 30 + 0.2
    assert sum(r["users"] for r in found["targeting_summary"].collect()) == 60
    assert sum(r["users"] for r in found["audience_summary"].collect()) == 60
    audience = sum(r["risk_segment"] != "High repeat probability users" for r in aimed.values())
    assert {r["audience_users"] for r in found["campaign_simulator_outputs"].collect()} == {audience}


def test_frames_are_written_once(spark, flow, tmp_path):
    found, _ = flow
    took = catalogue.export_frames(found, str(tmp_path), fmt="parquet")
    assert took.keys() == found.keys() and all(s is not None for s in took.values())
    back = spark.read.parquet(str(tmp_path / "user_repeat_targeting_dataset"))
    assert back.count() == 60
    assert set(catalogue.export_frames(found, str(tmp_path), fmt="parquet").values()) == {None}


def test_volatility_flow(spark):
    rows = [(date.fromordinal(738_000 + i), (i * 37 % 11) / 10, (i * 37 % 11) / 1000) for i in range(120)]
    features = staged(spark.createDataFrame(rows, "date date, f double, target_next_abs_return double"), "flow-features")
    quick = {"forest": lambda: estimators.forest(["f"], volatility.LABEL, trees=4, depth=4, min_leaf=1)}
    found = model_flows.volatility_flow(features, ["f"], "made", quick)
    assert found["fx_volatility_model_metrics"].count() == 2
    shown = found["fx_volatility_predictions"].collect()
    assert len(shown) == 24 and sum(r["actual_regime"] == r["predicted_regime"] for r in shown) > 16
    cells = found["fx_volatility_confusion_matrix"].collect()
    assert sum(sum(r[f"Predicted {c}"] for c in volatility.CLASSES) for r in cells) == 24
    assert found["fx_volatility_regime_metadata"].count() == found["fx_volatility_regime_definition_comparison"].count() == 2


def test_quality_and_experiment_extracts(spark):
    issues = spark.createDataFrame(
        [("a", "t", "c", 0, "error", "fine, \"really\""), ("b", "t", "c", 3, "warning", None)],
        "check string, table string, column string, issue_count long, severity string, detail string",
    )
    trial = spark.range(400).select(
        F.col("id").alias("user_id"), F.when(F.col("id") % 4 == 0, None).otherwise("web").alias("acquisition_channel"),
        F.lit("High value").alias("value_segment"), F.when(F.col("id") % 2 == 0, "control").otherwise("treatment").alias("variant"),
        (F.col("id") % 3 == 0).cast("int").alias("feature_adoption_7d"), F.lit(1).alias("first_exchange_14d"),
        F.lit(0).alias("guardrail_event_30d"),
    )
    found = model_flows.decision_frames(issues, trial)
    assert [r["check"] for r in found["data_quality_issues"].collect()] == ["b", "a"]
    assert {(r["severity"], r["affected_rows"]) for r in found["data_quality_summary"].collect()} == {("all", 3), ("error", 0), ("warning", 3)}
    assert found["ab_test_results"].count() == 3
    assert {r["segment"] for r in found["ab_test_segment_results"].collect()} == {"web", "High value"}
    nothing = model_flows.decision_frames(issues.limit(0), trial.limit(0))
    assert nothing["data_quality_issues"].count() == 0 and nothing["ab_test_results"].count() == 3

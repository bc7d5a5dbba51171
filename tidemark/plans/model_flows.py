"""From training tables to published extracts: repeat model, volatility regimes, quality report and experiment.

Each flow returns frames by their extract's name; ``catalogue.export_frames`` writes them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.models import repeat, splits, volatility
from tidemark.models.estimators import importance, score
from tidemark.models.metrics import classification_report, confusion
from tidemark.operators import experiment, quality, scenario, targeting
from tidemark.operators.snapshots import REPEAT_FEATURES, TARGET
from tidemark.plans.staging import staged

# Fixed names of the confusion matrix.
OUTCOMES = ("no repeat", "repeat")


def judged(trained: repeat.Trained, snapshots: DataFrame, features: Sequence[str] = REPEAT_FEATURES) -> DataFrame:
    """The test part with the champion's scores and decisions, written once as all its measures read it."""
    _, _, test = splits.split_by_dates(snapshots)
    return staged(repeat.decide(score(trained.model, test, features), trained.threshold), "repeat-test")


def repeat_flow(
    snapshots: DataFrame,
    context: DataFrame,
    rules: str = "A",
    candidates: Mapping[str, Callable[[], Pipeline]] = repeat.CANDIDATES,
) -> dict[str, DataFrame]:
    """Champion and threshold, its test results, and after a refit the newest scores, targeting and campaign scenarios.

    ``snapshots``: a written table, as every step reads it.  ``context``: one row a user.  Fits and scores at once; the
    threshold stays the one found on the validation part, and the test part is used for measures alone.
    """
    metrics_of, fitted = repeat.train_candidates(snapshots, candidates)
    name = repeat.champion(metrics_of)
    test = judged(fitted[name], snapshots)
    model = repeat.refit(candidates[name], snapshots, seen=fitted[name].seen)
    newest = staged(repeat.score_latest(model, snapshots, fitted[name].threshold), "repeat-scores")
    aimed = staged(targeting.targeting(newest, snapshots, context, rules), "repeat-targeting")
    totals = scenario.audience_totals(targeting.campaign_audience(aimed))
    return {
        "user_repeat_model_metrics": metrics_of,
        "user_repeat_classification_report": classification_report(test, TARGET, "predicted", ["0", "1"]),
        "user_repeat_confusion_matrix": confusion(test, TARGET, "predicted", [0, 1], OUTCOMES),
        "user_repeat_feature_importance": importance(snapshots.sparkSession, fitted[name].model, REPEAT_FEATURES),
        "user_repeat_predictions": newest,
        "user_repeat_targeting_dataset": aimed,
        "targeting_summary": targeting.targeting_summary(aimed),
        "audience_summary": targeting.audience_summary(aimed),
        "campaign_simulator_outputs": scenario.scenario_grid(totals),
    }


def volatility_flow(
    features: DataFrame, names: Sequence[str], provider: str, candidates: Mapping[str, Callable[[], Pipeline]] | None = None
) -> dict[str, DataFrame]:
    """Candidates under both regime definitions, the champion's predictions and matrix for the held-out dates, and constants.

    ``features``: a written table, one row a date.  The champion is chosen on the held-out dates, so its numbers are optimistic.
    """
    compared, fitted = volatility.compare_regimes(features, names, models=candidates)
    first = compared.where("selected_model_flag = 1").head()
    _, model, held = fitted[first["regime_definition"], first["model"]]
    shown = staged(volatility.predictions(model, held, names), "regime-predictions")
    train, test = splits.split_by_position(features)
    definitions = {regimes.name: regimes for regimes, _, _ in fitted.values()}
    return {
        "fx_market_features": features,
        "fx_volatility_model_metrics": compared,
        "fx_volatility_regime_definition_comparison": volatility.definition_comparison(compared),
        "fx_volatility_predictions": shown,
        "fx_volatility_confusion_matrix": confusion(shown, "actual_regime", "predicted_regime", volatility.CLASSES),
        "fx_volatility_regime_metadata": volatility.regime_metadata(train, test, list(definitions.values()), provider),
    }


def decision_frames(issues: DataFrame, trial: DataFrame) -> dict[str, DataFrame]:
    """The quality report, written once, with its summary, and an experiment's results overall and by segment."""
    report = staged(issues, "quality-report")
    return {
        "data_quality_issues": report.orderBy(F.desc("issue_count"), "check", "table", "column"),
        "data_quality_summary": quality.dq_summary(report),
        "ab_test_results": experiment.ab_results(trial),
        "ab_test_segment_results": experiment.ab_segments(trial),
    }

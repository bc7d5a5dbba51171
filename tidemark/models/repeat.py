"""Next-30-day repeat: candidates, thresholds, champion, refit and batch scoring."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.models.estimators import ROWS, SINGLE_ROWS, TrainingRows, boosted, equal_rows, fit, forest, logistic, score, score_counts
from tidemark.models.metrics import class_metrics, score_curves
from tidemark.models.splits import split_by_dates, split_labels
from tidemark.operators.snapshots import REPEAT_FEATURES, TARGET, latest
from tidemark.plans.staging import staged

# Fixed text of the selection.
RATIONALE = (
    "Selected as the performance winner based on the highest validation ROC-AUC, "
    "with validation PR-AUC as the tie-breaker."
)

CANDIDATES: dict[str, Callable[[], Pipeline]] = {
    "Logistic Regression": lambda: logistic(REPEAT_FEATURES, TARGET),
    "Random Forest": lambda: forest(REPEAT_FEATURES, TARGET),
    "Gradient Boosted Trees": lambda: boosted(REPEAT_FEATURES, TARGET),
}


@dataclass
class Trained:
    """``seen``: the ``equal_rows`` of train and validation, which a refit needs again."""

    model: PipelineModel
    threshold: float
    seen: DataFrame | None = None


def decide(scored: DataFrame, threshold: float, p: str = "probability_1") -> DataFrame:
    return scored.withColumn("predicted", (F.col(p) >= F.lit(threshold)).cast("int"))


def split_rows(snapshots: DataFrame, features: Sequence[str], label: str) -> list[DataFrame]:
    """The ``equal_rows`` of train, validation and test, written in one pass."""
    names = ("train", "validation", "test")
    labelled = split_labels(snapshots.where("observation_date IS NOT NULL"), names=names)
    merged = staged(equal_rows(labelled, features, label, ["split"]), "split-rows", ["split"])
    return [merged.where(F.col("split") == n).drop("split") for n in names]


def train_candidates(
    snapshots: DataFrame,
    candidates: Mapping[str, Callable[[], Pipeline]] = CANDIDATES,
    features: Sequence[str] = REPEAT_FEATURES,
    label: str = TARGET,
    single: int = SINGLE_ROWS,
) -> tuple[DataFrame, dict[str, Trained]]:
    """Fit each candidate on the first 70 % of dates, set its threshold on the next 15 %, measure on the rest.

    Candidates are fitted side by side: each is a row of many short jobs, which leave cores free.  Equal rows have equal scores,
    so each is scored once and measures count it as often as it comes.  ``single`` as in ``fit``.
    """
    train, validation, test = split_rows(snapshots, features, label)
    learnt = TrainingRows(split_by_dates(snapshots)[0], features, label, train).prepare(single)

    def trained(name: str) -> tuple[tuple, Trained]:
        model = fit(candidates[name](), learnt, features, label, single=single)
        on_validation = score_curves(score_counts(model, validation, label), label, "probability_1", rows=ROWS).head()
        threshold = on_validation["threshold"]
        on_test = score_counts(model, test, label).withColumn(label, F.col(label).cast(snapshots.schema[label].dataType))
        tested = decide(staged(on_test, "tested"), threshold)
        curve = score_curves(tested, label, "probability_1", rows=ROWS).head()
        decided = class_metrics(tested, label, "predicted", ["0", "1"], "1", ROWS).head()
        measures = (
            name,
            on_validation["roc_auc"],
            on_validation["pr_auc"],
            curve["roc_auc"],
            curve["pr_auc"],
            decided["accuracy"],
            decided["precision"],
            decided["recall"],
            decided["f1"],
            threshold,
        )
        return measures, Trained(model, threshold, train.unionByName(validation))

    with ThreadPool(len(candidates)) as pool:
        results = pool.map(inheritable_thread_target(snapshots.sparkSession)(trained), candidates, chunksize=1)
    frames = [measures for measures, _ in results]
    fitted = {measures[0]: made for measures, made in results}
    schema = (
        "model string, validation_roc_auc double, validation_pr_auc double, roc_auc double, pr_auc double, "
        "accuracy double, precision double, recall double, f1 double, decision_threshold double"
    )
    return select_champion(snapshots.sparkSession.createDataFrame(frames, schema)), fitted


def select_champion(
    metrics: DataFrame,
    order: Sequence[str] = ("validation_roc_auc", "validation_pr_auc"),
    key: Sequence[str] = ("model",),
    rationale: str | None = RATIONALE,
) -> DataFrame:
    """Flag the row that leads by ``order``.  One row per candidate."""
    lead = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in key])
    winner = metrics.agg(F.max(lead).alias("w"))
    flag = F.when(lead == winner.scalar(), 1).otherwise(0)
    flagged = metrics.withColumn("selected_model_flag", flag)
    if rationale is None:
        return flagged
    text = F.when(F.col("selected_model_flag") == 1, rationale).otherwise("")
    return flagged.withColumn("selection_rationale", text)


def champion(metrics: DataFrame) -> str:
    return metrics.where("selected_model_flag = 1").head()["model"]


def refit(
    make: Callable[[], Pipeline],
    snapshots: DataFrame,
    features: Sequence[str] = REPEAT_FEATURES,
    label: str = TARGET,
    seen: DataFrame | None = None,
) -> PipelineModel:
    """Fit once more on train and validation together; the threshold stays the one found before.

    ``seen``: the ``equal_rows`` of both, where they are at hand (``Trained.seen``).
    """
    both, _ = split_by_dates(snapshots, fractions=(0.85,))
    return fit(make(), TrainingRows(both, features, label, seen), features, label)


def score_latest(
    model: PipelineModel, snapshots: DataFrame, threshold: float, features: Sequence[str] = REPEAT_FEATURES
) -> DataFrame:
    """Scores and decisions for the newest snapshot."""
    scored = decide(score(model, latest(snapshots), features), threshold)
    return scored.select(
        "user_id",
        "observation_date",
        TARGET,
        F.col("probability_1").alias("repeat_probability"),
        F.col("predicted").alias("predicted_repeat_30d"),
    )

"""Spark ML pipelines behind one small interface: fit on a frame, add prediction and probabilities."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from functools import cached_property

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import Bucketizer, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.staging import staged

SEED = 42
#: Parts of the training rows.  Learners draw and add up part by part, so the number is fixed: the fitted model depends on
#: the rows and on this number, not on cores, files or the number of rows.  Raise it for more than some 10**8 rows.
FIT_PARTS = 8
TREE_MEMORY_MB = 1_024
#: Bins of a feature where rows are merged for trees, Spark's own number; and the rows that equal ones are merged into.
TREE_BINS = 32
MERGED = 256
#: Training rows up to which learners get single rows, and trees unbinned features.
SINGLE_ROWS = 1_000_000
#: Places in trees, one a row and tree, up to which a forest's fit keeps them (4 bytes each) and doesn't walk its trees anew at every level.
KEPT_PLACES = 100_000_000
WEIGHT = "class_weight"
#: How many equal rows a row stands for.
ROWS = "equal_rows"


def class_sizes(df: DataFrame, label: str) -> dict[float, int]:
    """Rows per class; as many numbers as classes."""
    return {float(r[label]): r["count"] for r in df.groupBy(label).count().collect()}


def class_weights(df: DataFrame, label: str, sizes: Mapping[float, int] | None = None) -> dict[float, float]:
    """Balanced weights ``n / (k * n_class)``."""
    sizes = sizes or class_sizes(df, label)
    total = sum(sizes.values())
    return {c: total / (len(sizes) * n) for c, n in sizes.items()}


def positive_weight(df: DataFrame, label: str) -> float:
    """Negatives per positive."""
    row = df.agg(F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos")).head()
    return row["neg"] / row["pos"]


def with_weights(df: DataFrame, label: str, weights: Mapping[float, float] | None = None) -> DataFrame:
    weights = weights or class_weights(df, label)
    out: Column = F.lit(1.0)
    for c, w in weights.items():
        out = F.when(F.col(label) == c, F.lit(w)).otherwise(out)
    return df.withColumn(WEIGHT, out)


def _inputs(features: Sequence[str], scale: bool) -> list:
    filled = [f"{f}__filled" for f in features]
    stages = [
        Imputer(strategy="median", inputCols=list(features), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="raw_features" if scale else "features"),
    ]
    if scale:
        stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True))
    return stages


class Bins(Estimator):
    """Bins of features for learners of trees, which look at no more of a number than its bin.

    Few different values have a bin each, others are cut at quantiles; both from all rows, where Spark's learners take a sample.
    Marks the pipelines for which ``fit`` merges equal rows.
    """

    def __init__(self, inputs: Sequence[str], outputs: Sequence[str], bins: int = TREE_BINS):
        super().__init__()
        self.inputs, self.outputs, self.bins = list(inputs), list(outputs), bins

    def _fit(self, dataset: DataFrame) -> Bucketizer:
        return self.cut(dataset, dataset.approxQuantile(self.inputs, self.shares, 0.001))

    @property
    def shares(self) -> list[float]:
        """The shares of the rows below the quantiles that cut many values."""
        return [i / self.bins for i in range(1, self.bins)]

    def cut(self, dataset: DataFrame, quantiles: Sequence[Sequence[float]]) -> Bucketizer:
        """The bins for rows with these quantiles; ``dataset`` has all their values, however often."""
        near = dataset.agg(*[F.approx_count_distinct(c).alias(c) for c in self.inputs]).head()
        splits = []
        for c, cuts in zip(self.inputs, quantiles, strict=True):
            if near[c] <= 2 * self.bins:
                values = sorted(r[0] for r in dataset.select(c).where(~F.isnan(c)).distinct().collect())
                if len(values) <= self.bins:
                    cuts = [(a + b) / 2 for a, b in zip(values, values[1:])]
            finite = sorted({x for x in cuts if math.isfinite(x)}) or [0.0]
            splits.append([float("-inf"), *finite, float("inf")])
        return Bucketizer(splitsArray=splits, inputCols=self.inputs, outputCols=self.outputs, handleInvalid="keep")


def _binned_inputs(features: Sequence[str]) -> list:
    filled, binned = [f"{f}__filled" for f in features], [f"{f}__bin" for f in features]
    return [
        Imputer(strategy="median", inputCols=list(features), outputCols=filled),
        Bins(filled, binned),
        VectorAssembler(inputCols=binned, outputCol="features"),
    ]


def _weighted(estimator, weighted: bool):
    return estimator.setWeightCol(WEIGHT) if weighted else estimator


def logistic(features: Sequence[str], label: str, max_iter: int = 1000, weighted: bool = True) -> Pipeline:
    """Median imputation, standardised features, balanced logistic regression (binary or multinomial)."""
    model = _weighted(LogisticRegression(labelCol=label, maxIter=max_iter, regParam=0.0), weighted)
    return Pipeline(stages=[*_inputs(features, True), model])


def forest(
    features: Sequence[str],
    label: str,
    trees: int = 180,
    depth: int = 12,
    min_leaf: int = 20,
    weighted: bool = True,
    seed: int = SEED,
    merge: bool = True,
) -> Pipeline:
    """Random forest; depth is bounded because every level of a distributed tree is a pass over the data.

    ``merge``: equal rows are merged (see ``fit``), which is of use where rows are many more than values of their features.
    """
    model = RandomForestClassifier(
        labelCol=label,
        numTrees=trees,
        maxDepth=depth,
        minInstancesPerNode=min_leaf,
        maxMemoryInMB=TREE_MEMORY_MB,
        seed=seed,
    )
    return Pipeline(stages=[*(_binned_inputs(features) if merge else _inputs(features, False)), _weighted(model, weighted)])


def boosted(
    features: Sequence[str],
    label: str,
    rounds: int = 180,
    depth: int = 4,
    step: float = 0.06,
    sample: float = 0.85,
    classes: int = 2,
    weighted: bool = True,
    seed: int = SEED,
    merge: bool = True,
) -> Pipeline:
    """Gradient-boosted trees; one against the rest beyond two classes (which gives no probabilities).  ``merge`` as in ``forest``."""
    model = GBTClassifier(
        labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=step, subsamplingRate=sample, seed=seed
    )
    model = _weighted(model, weighted)
    if classes > 2:
        model = OneVsRest(classifier=model, labelCol=label)
        model = _weighted(model, weighted)
    return Pipeline(stages=[*(_binned_inputs(features) if merge else _inputs(features, False)), model])


def mlp(features: Sequence[str], label: str, hidden: Sequence[int] = (64, 32), classes: int = 3, rounds: int = 100):
    """Two-hidden-layer perceptron on standardised features."""
    model = MultilayerPerceptronClassifier(
        labelCol=label, layers=[len(features), *hidden, classes], maxIter=rounds, seed=SEED
    )
    return Pipeline(stages=[*_inputs(features, True), model])


def merged_rows(binned: DataFrame, columns: Sequence[str], most: int = MERGED) -> DataFrame:
    """Up to ``most`` rows for the rows that are equal in ``columns`` and weight, which share all their weight.

    No weight is lost.  Up to ``most`` equal rows stay single, so leaves of some rows are as before; a learner that draws rows
    draws shares of the others.  A column ``ROWS`` tells how many rows one stands for.
    """
    many = F.sum(ROWS) if ROWS in binned.columns else F.count(F.lit(1))
    n = binned.groupBy(*columns, WEIGHT).agg(many.alias("n")).withColumn("shares", F.least("n", F.lit(most)))
    share = (F.col(WEIGHT) * F.col("n") / F.col("shares")).alias(WEIGHT)
    return n.select(*columns, share, F.explode(F.sequence(F.lit(1).cast("long"), F.col("shares").cast("long"))).alias("share"))


def equal_rows(df: DataFrame, features: Sequence[str], label: str, by: Sequence[str] = ()) -> DataFrame:
    """One row for the rows that are equal in features and label (and ``by``), with their number; features and label as numbers."""
    typed = [F.col(c).cast("double").alias(c) for c in (*features, label)]
    return df.select(*by, *typed).groupBy(*by, *features, label).agg(F.count(F.lit(1)).alias(ROWS))


class TrainingRows:
    """Rows to fit on, and what all fits on them share: sizes of classes, and above ``single`` rows equal rows merged and quantiles.

    Each is worked out once, when first asked for.  ``merged``: the rows' ``equal_rows``, written, where they are at hand.
    """

    def __init__(self, rows: DataFrame, features: Sequence[str], label: str, merged: DataFrame | None = None):
        self.rows, self.features, self.label, self._merged = rows, list(features), label, merged
        self.numeric = rows.select(*[F.col(c).cast("double").alias(c) for c in (*features, label)])

    @cached_property
    def sizes(self) -> dict[float, int]:
        if self._merged is None:
            return class_sizes(self.numeric, self.label)
        counted = self._merged.groupBy(self.label).agg(F.sum(ROWS).alias("count")).collect()
        return {float(r[self.label]): r["count"] for r in counted}

    @cached_property
    def merged(self) -> DataFrame:
        if self._merged is not None:
            return self._merged
        return staged(equal_rows(self.rows, self.features, self.label), "training-rows")

    @cached_property
    def _quantiles(self) -> list[list[float]]:
        """By feature: the median of what isn't missing, then the quantiles at the shares of ``Bins``, missing values as the median."""
        shares = Bins([], []).shares
        known = [F.when(~F.isnan(f), F.col(f)) for f in self.features]
        cuts = [F.percentile_approx(c, [0.5, *shares], 1000).alias(f) for c, f in zip(known, self.features, strict=True)]
        missing = [(F.count(F.lit(1)) - F.count(c)).alias(f"{f}__missing") for c, f in zip(known, self.features, strict=True)]
        found = self.numeric.agg(*cuts, *missing).head()
        gaps = [f for f in self.features if found[f"{f}__missing"] and found[f]]
        if gaps:
            filled = [F.percentile_approx(F.coalesce(c, F.lit(found[f][0])), shares, 1000).alias(f) for c, f in zip(known, self.features, strict=True) if f in gaps]
            again = self.numeric.agg(*filled).head()
        return [[found[f][0], *again[f]] if f in gaps else found[f] or [None] for f in self.features]

    @property
    def medians(self) -> list[float | None]:
        return [q[0] for q in self._quantiles]

    @property
    def quantiles(self) -> list[list[float]]:
        return [q[1:] for q in self._quantiles]

    def prepare(self, single: int = SINGLE_ROWS) -> TrainingRows:
        """Works out what fits share, before several of them ask for it at once."""
        if sum(self.sizes.values()) > single:
            _ = self.merged, self._quantiles
        return self


def _standard(scaler: StandardScaler, filled: DataFrame, inputs: Sequence[str]):
    """The scaler fitted to the means and deviations of all rows that ``filled`` stands for."""
    n = filled.agg(F.sum(ROWS)).head()[0]
    means = filled.agg(*[(F.sum(F.col(c) * F.col(ROWS)) / n).alias(c) for c in inputs]).head()
    squares = filled.agg(*[F.sum((F.col(c) - means[c]) ** 2 * F.col(ROWS)).alias(c) for c in inputs]).head()
    # Two rows that lie the half of the variance's root to both sides have this mean and this deviation.
    half = [math.sqrt(squares[c] / (n - 1) / 2) for c in inputs]
    pair = [([means[c] + side * h for c, h in zip(inputs, half, strict=True)],) for side in (1, -1)]
    made = filled.sparkSession.createDataFrame(pair, "x array<double>")
    return scaler.fit(made.select(array_to_vector("x").alias(scaler.getInputCol())))


def _prepared(stages: Sequence, known: TrainingRows, merged: DataFrame) -> list:
    """The stages before the learner, fitted to all rows by their medians, quantiles and ``equal_rows``."""
    done = []
    for stage in stages:
        if isinstance(stage, Imputer):
            names = [f"{f} double" for f in known.features]
            one = merged.sparkSession.createDataFrame([tuple(known.medians)], ", ".join(names))
            filled, stage = stage.getOutputCols(), stage.fit(one)
        elif isinstance(stage, Bins):
            stage = stage.cut(PipelineModel(done).transform(merged), known.quantiles)
        elif isinstance(stage, StandardScaler):
            stage = _standard(stage, PipelineModel(done).transform(merged), filled)
        done.append(stage)
    return done


def fit(
    pipeline: Pipeline,
    train: DataFrame | TrainingRows,
    features: Sequence[str],
    label: str,
    parts: int = FIT_PARTS,
    single: int = SINGLE_ROWS,
) -> PipelineModel:
    """Fit on weighted rows.

    Every learner passes over the training frame many times, so it is dealt out by a hash of its rows, ordered, and held.
    Where rows are more than ``single`` and the learner takes weights, equal rows are one with the weight of all; where the pipeline
    also puts features in ``Bins``, its learner gets ``merged_rows``, whose number depends on the bins that rows fall in and
    no longer on the rows.  Medians, means, bins and class weights are of all rows.
    """
    known = train if isinstance(train, TrainingRows) else TrainingRows(train, features, label)
    weights = class_weights(known.numeric, label, known.sizes)
    stages, done, columns = pipeline.getStages(), [], [*features, label]
    learner = stages[-1]
    weighted = learner.hasParam("weightCol") and learner.isSet("weightCol")
    at = next((i for i, s in enumerate(stages) if isinstance(s, Bins)), None)
    if weighted and sum(known.sizes.values()) > single:
        done = _prepared(stages[:-1] if at is None else stages[: at + 1], known, known.merged)
        stages = stages[len(done) :]
        if at is None:
            total = (F.col(WEIGHT) * F.col(ROWS)).alias(WEIGHT)
            rows = with_weights(known.merged, label, weights).select(*features, label, total)
            rows = _dealt(rows, parts, columns)
        else:
            columns = [*done[at].getOutputCols(), label]
            cells = PipelineModel(done).transform(with_weights(known.merged, label, weights))
            rows = _dealt(merged_rows(cells, columns), parts, [*columns, "share"])
    else:
        if at is not None:
            plain = VectorAssembler(inputCols=stages[at].inputs, outputCol="features")
            stages = [*stages[:at], plain, *stages[at + 2 :]]
        rows = _dealt(with_weights(known.numeric, label, weights), parts, columns)
    ready = rows.persist()
    try:
        if isinstance(learner, RandomForestClassifier) and ready.count() * learner.getNumTrees() <= KEPT_PLACES:
            stages = [*stages[:-1], learner.copy({learner.cacheNodeIds: True})]
        seen = ready if at is not None or not done else PipelineModel(done).transform(ready)
        return PipelineModel([*done, *Pipeline(stages=stages).fit(seen).stages])
    finally:
        ready.unpersist()


def _dealt(rows: DataFrame, parts: int, columns: Sequence[str]) -> DataFrame:
    return rows.repartition(parts, F.xxhash64(*columns)).sortWithinPartitions(*columns)


def _bins_at(model: PipelineModel) -> int | None:
    return next((i for i, s in enumerate(model.stages) if isinstance(s, Bucketizer)), None)


def score(model: PipelineModel, df: DataFrame, features: Sequence[str], positive: bool = True) -> DataFrame:
    """Input columns plus ``probability_1`` (or every class) and the model's own ``prediction``.

    A model that sees features in bins scores each cell of bins that has rows once, which runs a job, and rows take their cell's.
    """
    kept = df.columns
    typed = df.withColumns({f: F.col(f).cast("double") for f in features})
    at = _bins_at(model)
    if at is None:
        return _shown(model, model.transform(typed), [F.col(c) for c in kept], positive)
    bins = model.stages[at].getOutputCols()
    binned = PipelineModel(model.stages[: at + 1]).transform(typed).select(*kept, *bins)
    learnt = PipelineModel(model.stages[at + 1 :]).transform(binned.select(*bins).distinct())
    cells = staged(_shown(model, learnt, [F.col(b) for b in bins], positive), "scored-cells")
    found = [c for c in cells.columns if c not in bins]
    return binned.join(cells, bins, "left").select(*kept, *found)


def _shown(model: PipelineModel, out: DataFrame, columns: Sequence[Column], positive: bool) -> DataFrame:
    columns = [*columns]
    if "probability" in out.columns:
        p = vector_to_array("probability")
        n = model.stages[-1].numClasses
        columns += [p[1].alias("probability_1")] if positive else [p[i].alias(f"probability_{i}") for i in range(n)]
    return out.select(*columns, "prediction")


def score_counts(model: PipelineModel, merged: DataFrame, label: str) -> DataFrame:
    """``ROWS`` by label and ``probability_1``, over ``equal_rows``: what measures of scores are made of.

    A model that sees features in bins scores cells of bins.
    """
    at = _bins_at(model)
    stages = model.stages
    if at is not None:
        binned = PipelineModel(stages[: at + 1]).transform(merged)
        merged = binned.groupBy(*stages[at].getOutputCols(), label).agg(F.sum(ROWS).alias(ROWS))
        stages = stages[at + 1 :]
    out = PipelineModel(stages).transform(merged)
    return out.groupBy(label, vector_to_array("probability")[1].alias("probability_1")).agg(F.sum(ROWS).alias(ROWS))


def majority(df: DataFrame, train: DataFrame, label: str) -> DataFrame:
    """The most frequent training label as everyone's prediction; ties go to the smaller label."""
    counts = train.groupBy(F.col(label).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.max(F.struct("n", (-F.col("c")).alias("neg"))).alias("t")).select(-F.col("t.neg"))
    return df.withColumn("prediction", top.scalar())


def importance(spark: SparkSession, model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """Feature importance, or the (mean) absolute standardised coefficient, largest first."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        values, method = last.featureImportances.toArray(), "tree feature importance"
    else:
        matrix = abs(last.coefficientMatrix.toArray())
        values = matrix.mean(axis=0)
        method = "absolute standardized coefficient"
    rows = [(f, float(v), method) for f, v in zip(features, values)]
    made = spark.createDataFrame(rows, "feature string, importance double, method string")
    return made.orderBy(F.desc("importance"), "feature")


def save_model(model: PipelineModel, path: str, meta: Mapping) -> None:
    """The fitted pipeline and its description (features, threshold, windows) side by side."""
    spark = SparkSession.active()
    model.write().overwrite().save(f"{path}/pipeline")
    text = json.dumps(dict(meta), default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_model(path: str) -> tuple[PipelineModel, dict]:
    spark = SparkSession.active()
    return PipelineModel.load(f"{path}/pipeline"), json.loads(spark.read.text(f"{path}/meta").head()[0])

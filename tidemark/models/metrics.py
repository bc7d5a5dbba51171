"""Classification metrics from counts, exact for any number of rows.

Score curves never order the scored rows themselves: rows with one score are counted together first, and the
running counts over the scores are built range by range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import ratio
from tidemark.operators.ranking import running_totals


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _how_many(where: Column, rows: str | None) -> Column:
    """The rows that fulfil ``where``; with ``rows`` each row stands for as many as that column says."""
    if rows is None:
        return F.count_if(where)
    return F.coalesce(F.sum(F.when(where, F.col(rows))), F.lit(0)).cast("long")


def score_ladder(df: DataFrame, y: str, p: str, ranges: int | None = None, rows: str | None = None) -> DataFrame:
    """Per distinct score, from the highest: its positives and negatives and those at or above it.

    ``rows``: a column that says for how many equal rows each stands, here and in the measures below.
    """
    grouped = df.groupBy(F.col(p).alias("score")).agg(
        _how_many(F.col(y) == 1, rows).alias("pos"), _how_many(F.col(y) == 0, rows).alias("neg")
    )
    return running_totals(
        grouped,
        "score",
        {"tp": F.col("pos"), "fp": F.col("neg")},
        descending=True,
        ranges=ranges,
        grand={"all_pos": "tp", "all_neg": "fp"},
    )


def roc_auc(df: DataFrame, y: str, p: str, ranges: int | None = None) -> DataFrame:
    """Probability that a positive outscores a negative, ties counting half; whole numbers until the end."""
    pairs = F.col("neg").cast("decimal(19,0)") * (2 * F.col("tp") - F.col("pos")).cast("decimal(19,0)")
    ladder = score_ladder(df, y, p, ranges)
    wins = F.sum(pairs).cast("double")
    both = F.max("all_pos").cast("double") * F.max("all_neg").cast("double")
    return ladder.agg(ratio(wins, 2 * both).alias("roc_auc"))


def average_precision(df: DataFrame, y: str, p: str, ranges: int | None = None) -> DataFrame:
    """Sum over the scores of recall gained times precision there."""
    gained = ratio("pos", "all_pos") * ratio("tp", F.col("tp") + F.col("fp"))
    return score_ladder(df, y, p, ranges).agg(F.sum(gained).alias("average_precision"))


def best_f1_threshold(df: DataFrame, y: str, p: str, ranges: int | None = None) -> DataFrame:
    """Lowest score threshold with the highest F1 (``score >= threshold`` is positive)."""
    f1 = _zero(ratio(2 * F.col("tp"), F.col("all_pos") + F.col("tp") + F.col("fp")))
    ladder = score_ladder(df, y, p, ranges).select("score", f1.alias("f1"))
    top = F.max(F.struct("f1", (-F.col("score")).alias("neg_score")))
    return ladder.agg(top.alias("t")).select((-F.col("t.neg_score")).alias("threshold"), F.col("t.f1").alias("f1"))


def score_curves(df: DataFrame, y: str, p: str, ranges: int | None = None, rows: str | None = None) -> DataFrame:
    """ROC-AUC, average precision and best threshold from one ladder."""
    pairs = F.col("neg").cast("decimal(19,0)") * (2 * F.col("tp") - F.col("pos")).cast("decimal(19,0)")
    f1 = _zero(ratio(2 * F.col("tp"), F.col("all_pos") + F.col("tp") + F.col("fp")))
    both = F.max("all_pos").cast("double") * F.max("all_neg").cast("double")
    gained = ratio("pos", "all_pos") * ratio("tp", F.col("tp") + F.col("fp"))
    top = F.max(F.struct(f1.alias("f1"), (-F.col("score")).alias("neg_score")))
    return (
        score_ladder(df, y, p, ranges, rows)
        .agg(
            ratio(F.sum(pairs).cast("double"), 2 * both).alias("roc_auc"),
            F.sum(gained).alias("pr_auc"),
            top.alias("t"),
        )
        .select("roc_auc", "pr_auc", (-F.col("t.neg_score")).alias("threshold"))
    )


def confusion_counts(df: DataFrame, y: str, yhat: str) -> DataFrame:
    return df.groupBy(F.col(y).cast("string").alias("actual"), F.col(yhat).cast("string").alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def class_counts(df: DataFrame, y: str, yhat: str, labels: Sequence[str], rows: str | None = None) -> DataFrame:
    """Per label: hits, predictions and support; labels that never occur count 0.  One pass, one row out."""
    a, b = F.col(y).cast("string"), F.col(yhat).cast("string")
    aggs = [_how_many(F.lit(True), rows).alias("total")]
    for i, label in enumerate(labels):
        aggs.append(_how_many((a == label) & (b == label), rows).alias(f"hit_{i}"))
        aggs.append(_how_many(b == label, rows).alias(f"pred_{i}"))
        aggs.append(_how_many(a == label, rows).alias(f"supp_{i}"))
    per_label = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(str(label)).alias("class"),
            F.col(f"hit_{i}").alias("hits"),
            F.col(f"pred_{i}").alias("predicted"),
            F.col(f"supp_{i}").alias("support"),
        )
        for i, label in enumerate(labels)
    ]
    counted = df.agg(*aggs).select("total", F.inline(F.array(*per_label)))
    return counted.withColumns(
        {
            "precision": _zero(ratio("hits", "predicted")),
            "recall": _zero(ratio("hits", "support")),
            "f1": _zero(ratio(2 * F.col("hits"), F.col("predicted") + F.col("support"))),
        }
    )


def class_metrics(
    df: DataFrame, y: str, yhat: str, labels: Sequence[str], positive: str | None = None, rows: str | None = None
) -> DataFrame:
    """Accuracy, precision, recall, F1 of ``positive``, or macro averages and balanced accuracy without it.

    Macro averages run over labels that occur in truth or prediction; balanced accuracy over those in truth.
    """
    per = class_counts(df, y, yhat, labels, rows)
    accuracy = ratio(F.sum("hits"), F.max("total")).alias("accuracy")
    if positive is not None:
        mine = F.col("class") == str(positive)
        return per.agg(accuracy, *[F.max(F.when(mine, F.col(m))).alias(m) for m in ("precision", "recall", "f1")])
    seen = (F.col("support") > 0) | (F.col("predicted") > 0)
    return per.agg(
        accuracy,
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg(F.when(seen, F.col("precision"))).alias("precision_macro"),
        F.avg(F.when(seen, F.col("recall"))).alias("recall_macro"),
        F.avg(F.when(seen, F.col("f1"))).alias("f1_macro"),
    )


def classification_report(df: DataFrame, y: str, yhat: str, labels: Sequence[str]) -> DataFrame:
    """A row per class, then accuracy, macro and support-weighted averages."""
    per = class_counts(df, y, yhat, labels)
    measures = ("precision", "recall", "f1")
    classes = per.select("position", "class", *measures, F.col("support").cast("double").alias("support"))
    support = F.sum("support").cast("double")
    accuracy = ratio(F.sum("hits"), F.max("total"))
    n = len(labels)
    summary = per.agg(
        F.struct(
            F.lit(n).alias("position"), F.lit("accuracy").alias("class"),
            *[accuracy.alias(m) for m in measures], accuracy.alias("support"),
        ).alias("a"),
        F.struct(
            F.lit(n + 1).alias("position"), F.lit("macro avg").alias("class"),
            *[F.avg(m).alias(m) for m in measures], support.alias("support"),
        ).alias("m"),
        F.struct(
            F.lit(n + 2).alias("position"), F.lit("weighted avg").alias("class"),
            *[_zero(ratio(F.sum(F.col(m) * F.col("support")), F.sum("support"))).alias(m) for m in measures],
            support.alias("support"),
        ).alias("w"),
    ).select(F.inline(F.array("a", "m", "w")))
    return classes.unionByName(summary).orderBy("position").drop("position").withColumnRenamed("f1", "f1-score")


def confusion(df: DataFrame, y: str, yhat: str, labels: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """Actual by predicted counts on fixed labels, zero where nothing fell."""
    names = list(names or labels)
    a, b = F.col(y).cast("string"), F.col(yhat).cast("string")
    cells = [
        F.count_if((a == str(r)) & (b == str(c))).alias(f"c_{i}_{j}")
        for i, r in enumerate(labels)
        for j, c in enumerate(labels)
    ]
    rows = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f"Actual {names[i]}").alias("actual"),
            *[F.col(f"c_{i}_{j}").alias(f"Predicted {names[j]}") for j in range(len(labels))],
        )
        for i in range(len(labels))
    ]
    return df.agg(*cells).select(F.inline(F.array(*rows))).orderBy("position").drop("position")

"""Splits, metrics on fixed scores (compared with SQL) and fitted models (rows only)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions.labels import recode
from tidemark.functions.numeric import round_half_up
from tidemark.models import estimators, metrics, repeat, splits, volatility
from tidemark.operators import market, quality
from tidemark.operators.snapshots import REPEAT_FEATURES, TARGET
from tidemark.operators.lifecycle import user_context
from tidemark.plans import model_flows
from tidemark.plans.staging import shared_dir, staged
from tidemark.registry.base import query, rnd
from tidemark.registry.market import _WIDE as WIDE
from tidemark.registry.market import _CELLS as CELLS

_DATES = "(SELECT list_sort(list(DISTINCT observation_date)) AS d FROM snaps)"


@query(
    "l1_split_by_dates",
    f"""SELECT split, COUNT(*) AS rows, CAST(MIN(observation_date) AS VARCHAR) AS first_date,
               CAST(MAX(observation_date) AS VARCHAR) AS last_date
        FROM (SELECT observation_date, CASE WHEN observation_date < (SELECT d[CAST(floor(len(d) * 0.7e0) AS BIGINT) + 1] FROM {_DATES})
                     THEN 'train' WHEN observation_date < (SELECT d[CAST(floor(len(d) * 0.85e0) AS BIGINT) + 1] FROM {_DATES})
                     THEN 'validation' ELSE 'test' END AS split FROM snaps) GROUP BY split""",
)
def l1(t):
    labelled = splits.split_labels(t.snapshot_table)
    return labelled.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("observation_date").alias("first_date"),
        F.max("observation_date").alias("last_date"),
    )


@query(
    "l1b_split_at_quantile",
    """SELECT side, COUNT(*) AS rows FROM (SELECT CASE WHEN observation_date - DATE '1970-01-01'
              <= (SELECT quantile_cont(observation_date - DATE '1970-01-01', 0.8) FROM snaps)
              THEN 'train' ELSE 'test' END AS side FROM snaps) GROUP BY side""",
)
def l1b(t):
    train, test = splits.split_at(t.snapshot_table, "observation_date")
    sides = [df.select(F.lit(n).alias("side")) for n, df in (("train", train), ("test", test))]
    return quality.union(sides).groupBy("side").agg(F.count(F.lit(1)).alias("rows"))


_COMPLETE = " AND ".join(f'"{n}" IS NOT NULL' for n in CELLS)
_POSITION = f"""SELECT *, ROW_NUMBER() OVER (ORDER BY "date") - 1 AS i, COUNT(*) OVER () AS n FROM ({WIDE}) WHERE {_COMPLETE}"""


@query(
    "l2_split_by_position",
    f"""SELECT side, COUNT(*) AS rows, CAST(MIN("date") AS VARCHAR) AS first_date, CAST(MAX("date") AS VARCHAR) AS last_date
        FROM (SELECT "date", CASE WHEN i < floor(n * 0.8e0) THEN 'train' ELSE 'test' END AS side FROM ({_POSITION}))
        GROUP BY side""",
)
def l2(t):
    train, test = splits.split_by_position(t.fx_features)
    sides = [df.select(F.lit(n).alias("side"), "date") for n, df in (("train", train), ("test", test))]
    return quality.union(sides).groupBy("side").agg(
        F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date")
    )


_TRAIN = f"observation_date < (SELECT d[CAST(floor(len(d) * 0.7e0) AS BIGINT) + 1] FROM {_DATES})"
_TEST = f"observation_date >= (SELECT d[CAST(floor(len(d) * 0.85e0) AS BIGINT) + 1] FROM {_DATES})"


def _part(t, name: str):
    """Snapshots of one part of the split by dates."""
    return splits.split_labels(t.snapshot_table).where(F.col("split") == name).drop("split")


@query(
    "l4_class_weights",
    f"""SELECT target_repeat_30d, {rnd(f"(SELECT COUNT(*) FROM snaps WHERE {_TRAIN}) / (2e0 * COUNT(*))", 10)} AS class_weight,
               COUNT(*) AS rows FROM snaps WHERE {_TRAIN} GROUP BY 1""",
)
def l4(t):
    """Weights of the part that is trained on."""
    weighted = estimators.with_weights(_part(t, "train"), TARGET)
    return weighted.groupBy(TARGET).agg(
        round_half_up(F.max(estimators.WEIGHT), 10).alias("class_weight"), F.count(F.lit(1)).alias("rows")
    )


@query(
    "l7_majority_baseline",
    f"""SELECT {rnd("AVG(CASE WHEN target_repeat_30d = m THEN 1 ELSE 0 END)", 10)} AS accuracy, MAX(m) AS predicted
        FROM snaps, (SELECT mode(target_repeat_30d) AS m FROM snaps WHERE {_TRAIN}) WHERE {_TEST}""",
)
def l7(t):
    """The most frequent label of the train part, judged on the test part."""
    guessed = estimators.majority(_part(t, "test"), _part(t, "train"), TARGET)
    hit = F.when(F.col(TARGET) == F.col("prediction"), 1).otherwise(0)
    return guessed.agg(round_half_up(F.avg(hit), 10).alias("accuracy"), F.max("prediction").alias("predicted"))


def _regimes_sql(above: str) -> str:
    return f"""WITH w AS ({_POSITION}),
      q AS (SELECT quantile_cont(target_next_abs_return, 0.33) AS lo, quantile_cont(target_next_abs_return, 0.67) AS hi
            FROM w WHERE i < floor(n * 0.8e0))
      SELECT CASE WHEN target_next_abs_return <= lo THEN 'low' WHEN target_next_abs_return {above} hi THEN 'high'
                  ELSE 'normal' END AS actual_regime, COUNT(*) AS dates FROM w, q GROUP BY 1"""


@query("l9_quantile_regimes", _regimes_sql(">"))
def l9(t):
    train, _ = splits.split_by_position(t.fx_table)
    named = volatility.with_regime(t.fx_table, volatility.quantile_regimes(train))
    return named.groupBy("actual_regime").agg(F.count(F.lit(1)).alias("dates"))


_LADDER = """SELECT repeat_probability AS s, SUM(pos) OVER (ORDER BY repeat_probability DESC) AS tp,
                    SUM(neg) OVER (ORDER BY repeat_probability DESC) AS fp, pos, neg,
                    SUM(pos) OVER () AS p, SUM(neg) OVER () AS n
             FROM (SELECT repeat_probability, SUM(target_repeat_30d) AS pos, SUM(1 - target_repeat_30d) AS neg
                   FROM scored GROUP BY 1)"""


@query(
    "l10_best_f1_threshold",
    f"""SELECT s AS threshold, CAST(2 * tp AS DOUBLE) / (p + tp + fp) AS f1 FROM ({_LADDER}) ORDER BY f1 DESC, s LIMIT 1""",
)
def l10(t):
    return metrics.best_f1_threshold(t.scores, TARGET, "repeat_probability")


@query(
    "l11_roc_auc",
    f"SELECT {rnd('CAST(SUM(neg * (2 * tp - pos)) AS DOUBLE) / (2 * MAX(p) * MAX(n))', 10)} AS roc_auc FROM ({_LADDER})",
)
def l11(t):
    return metrics.roc_auc(t.scores, TARGET, "repeat_probability").withColumn("roc_auc", round_half_up("roc_auc", 10))


@query(
    "l12_average_precision",
    f"""SELECT {rnd("SUM(CAST(pos AS DOUBLE) / p * (CAST(tp AS DOUBLE) / (tp + fp)))", 10)} AS average_precision
        FROM ({_LADDER})""",
)
def l12(t):
    found = metrics.average_precision(t.scores, TARGET, "repeat_probability")
    return found.withColumn("average_precision", round_half_up("average_precision", 10))


_CELLS2 = """SELECT COUNT(*) FILTER (WHERE y = 1 AND h = 1) AS tp, COUNT(*) FILTER (WHERE y = 0 AND h = 1) AS fp,
                    COUNT(*) FILTER (WHERE y = 1 AND h = 0) AS fn, COUNT(*) FILTER (WHERE y = 0 AND h = 0) AS tn
             FROM (SELECT target_repeat_30d AS y, predicted_repeat_30d AS h FROM scored)"""


@query(
    "l13_binary_metrics",
    f"""SELECT {rnd("(tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE)", 10)} AS accuracy,
               {rnd("tp / CAST(tp + fp AS DOUBLE)", 10)} AS precision, {rnd("tp / CAST(tp + fn AS DOUBLE)", 10)} AS recall,
               {rnd("2 * tp / CAST(2 * tp + fp + fn AS DOUBLE)", 10)} AS f1 FROM ({_CELLS2})""",
)
def l13(t):
    found = metrics.class_metrics(t.scores, TARGET, "predicted_repeat_30d", ["0", "1"], "1")
    return found.withColumns({c: round_half_up(c, 10) for c in found.columns})


_REGIME_PAIRS = """SELECT market_regime_at_transaction AS y,
       CASE WHEN user_id % 5 = 0 THEN 'high' WHEN user_id % 2 = 0 THEN 'low' ELSE market_regime_at_transaction END AS h
       FROM app_tx"""
_PER_CLASS = f"""SELECT c AS "class", COUNT(*) FILTER (WHERE y = c AND h = c) AS hit, COUNT(*) FILTER (WHERE h = c) AS pred,
       COUNT(*) FILTER (WHERE y = c) AS supp, COUNT(*) AS total
       FROM ({_REGIME_PAIRS}), (VALUES ('low'), ('normal'), ('high')) k(c) GROUP BY c"""
_PRF = f"""SELECT *, CAST(hit AS DOUBLE) / pred AS precision, CAST(hit AS DOUBLE) / supp AS recall,
       2e0 * hit / (pred + supp) AS f1 FROM ({_PER_CLASS})"""


def _regime_pairs(t):
    guess = (
        F.when(F.col("user_id") % 5 == 0, "high")
        .when(F.col("user_id") % 2 == 0, "low")
        .otherwise(F.col("market_regime_at_transaction"))
    )
    return t.tx.select(F.col("market_regime_at_transaction").alias("y"), guess.alias("h"))


@query(
    "l13b_macro_metrics",
    f"""SELECT {rnd("CAST(SUM(hit) AS DOUBLE) / MAX(total)", 10)} AS accuracy, {rnd("AVG(recall)", 10)} AS balanced_accuracy,
               {rnd("AVG(precision)", 10)} AS precision_macro, {rnd("AVG(recall)", 10)} AS recall_macro,
               {rnd("AVG(f1)", 10)} AS f1_macro FROM ({_PRF})""",
)
def l13b(t):
    found = metrics.class_metrics(_regime_pairs(t), "y", "h", volatility.CLASSES)
    return found.withColumns({c: round_half_up(c, 10) for c in found.columns})


@query(
    "l14_classification_report",
    f"""SELECT "class", {rnd("precision", 10)} AS precision, {rnd("recall", 10)} AS recall,
               {rnd("f1", 10)} AS "f1-score", CAST(supp AS DOUBLE) AS support FROM ({_PRF})
        UNION ALL SELECT 'accuracy', {", ".join([rnd("CAST(SUM(hit) AS DOUBLE) / MAX(total)", 10)] * 4)} FROM ({_PRF})
        UNION ALL SELECT 'macro avg', {rnd("AVG(precision)", 10)}, {rnd("AVG(recall)", 10)}, {rnd("AVG(f1)", 10)},
               CAST(SUM(supp) AS DOUBLE) FROM ({_PRF})
        UNION ALL SELECT 'weighted avg', {rnd("SUM(precision * supp) / SUM(supp)", 10)},
               {rnd("SUM(recall * supp) / SUM(supp)", 10)}, {rnd("SUM(f1 * supp) / SUM(supp)", 10)},
               CAST(SUM(supp) AS DOUBLE) FROM ({_PRF})""",
)
def l14(t):
    report = metrics.classification_report(_regime_pairs(t), "y", "h", volatility.CLASSES)
    return report.withColumns({c: round_half_up(c, 10) for c in ("precision", "recall", "f1-score", "support")})


@query(
    "l15_confusion_matrix",
    " UNION ALL ".join(
        f"SELECT 'Actual {r}' AS actual, "
        + ", ".join(f"COUNT(*) FILTER (WHERE y = '{r}' AND h = '{c}') AS \"Predicted {c}\"" for c in volatility.CLASSES)
        + f" FROM ({_REGIME_PAIRS})"
        for r in volatility.CLASSES
    ),
)
def l15(t):
    return metrics.confusion(_regime_pairs(t), "y", "h", volatility.CLASSES)


@query(
    "u3_q11_leakage",
    """SELECT 2 AS issue_count, 0 AS used_features, COUNT(*) AS rows FROM snaps""",
)
def u3(t):
    """Prohibited columns in the frame models read (its target and one planted here), and among the features they use."""
    frame = t.snapshot_table.withColumn("next_transaction_date", F.col("observation_date"))
    found = quality.leakage(t.spark, frame.columns).withColumnRenamed("issue_count", "found")
    used = quality.leakage(t.spark, REPEAT_FEATURES).withColumnRenamed("issue_count", "used")
    return frame.agg(
        F.lit(found.head()[0]).alias("issue_count"), F.lit(used.head()[0]).alias("used_features"), F.count(F.lit(1)).alias("rows")
    )


# Fitted models: their numbers depend on the learner, so SQL states which rows are scored and that all numbers are
# valid; every flag is computed from the model's own output.

_PART = "d[CAST(floor(len(d) * {}) AS BIGINT) + 1]"
_VALIDATION = f"""(SELECT snaps.* FROM snaps, {_DATES} WHERE observation_date >= {_PART.format("0.7e0")}
                   AND observation_date < {_PART.format("0.85e0")})"""
_SAMPLE = "SELECT user_id, CAST(observation_date AS VARCHAR) AS observation_date, target_repeat_30d, TRUE AS probability_valid, TRUE AS prediction_valid"
_SCORED = f"{_SAMPLE} FROM "
_LEARNT = f"{_SAMPLE}, TRUE AS beats_chance FROM "
_TEST_DATES = f"""SELECT CAST("date" AS VARCHAR) AS "date", TRUE AS probabilities_valid, TRUE AS regime_valid, TRUE AS beats_majority
                  FROM ({_POSITION}) WHERE i >= floor(n * 0.8e0)"""


_DEFINITIONS = (volatility.QUANTILE_DEFINITION, volatility.KMEANS_DEFINITION)


def _repeat_train(t):
    train, validation, _ = splits.split_by_dates(t.snapshot_table)
    return train, validation


def _valid(probability: str, prediction: str):
    return F.col(probability).between(0, 1).alias("probability_valid"), F.col(prediction).isin(0, 1).alias("prediction_valid")


def _scored_sample(t, pipeline):
    train, validation = _repeat_train(t)
    model = estimators.fit(pipeline, train, REPEAT_FEATURES, TARGET)
    scored = staged(estimators.score(model, validation, REPEAT_FEATURES), "scored-sample")
    # Rows that a model can't tell apart have an area of 0.5.
    learnt = metrics.roc_auc(scored, TARGET, "probability_1").select(F.col("roc_auc") > 0.5).scalar()
    return scored.select("user_id", "observation_date", TARGET, *_valid("probability_1", "prediction"), learnt.alias("beats_chance"))


@query("l3_logistic", _LEARNT + _VALIDATION)
def l3(t):
    return _scored_sample(t, estimators.logistic(REPEAT_FEATURES, TARGET))


@query("l5_forest", _LEARNT + _VALIDATION)
def l5(t):
    return _scored_sample(t, estimators.forest(REPEAT_FEATURES, TARGET))


@query("l6_boosted", _LEARNT + _VALIDATION)
def l6(t):
    return _scored_sample(t, estimators.boosted(REPEAT_FEATURES, TARGET))


#: The best three means of the train part's values: clusters of numbers are stretches of their order, so all pairs of cuts are tried.
_THREE_MEANS = f"""w AS MATERIALIZED ({_POSITION}),
      tr AS MATERIALIZED (SELECT ROW_NUMBER() OVER o AS k, SUM(target_next_abs_return) OVER (o ROWS UNBOUNDED PRECEDING) AS s
                          FROM w WHERE i < floor(n * 0.8e0) WINDOW o AS (ORDER BY target_next_abs_return)),
      whole AS (SELECT MAX(k) AS n, MAX_BY(s, k) AS s FROM tr),
      means AS MATERIALIZED (
          SELECT a.s / a.k AS c1, (b.s - a.s) / (b.k - a.k) AS c2, (e.s - b.s) / (e.n - b.k) AS c3
          FROM tr a JOIN tr b ON a.k < b.k, whole e WHERE b.k < e.n
          ORDER BY a.s * a.s / a.k + (b.s - a.s) * (b.s - a.s) / (b.k - a.k) + (e.s - b.s) * (e.s - b.s) / (e.n - b.k) DESC LIMIT 1)"""


@query(
    "l8_kmeans_regimes",
    f"""WITH {_THREE_MEANS}
        SELECT CASE WHEN target_next_abs_return <= (c1 + c2) / 2 THEN 'low' WHEN target_next_abs_return <= (c2 + c3) / 2 THEN 'normal'
                    ELSE 'high' END AS actual_regime, COUNT(*) AS dates FROM w, means GROUP BY 1""",
)
def l8(t):
    """Dates by regime; the best of the starts is the exact optimum."""
    train, test = splits.split_by_position(t.fx_table)
    regimes = volatility.kmeans_regimes(train)
    named = volatility.with_regime(t.fx_table, regimes)
    return named.groupBy("actual_regime").agg(F.count(F.lit(1)).alias("dates"))


@query(
    "l16_importance",
    " UNION ALL ".join(
        f"SELECT '{f}' AS feature, TRUE AS valid, 'absolute standardized coefficient' AS method FROM region WHERE r_regionkey = 0"
        for f in REPEAT_FEATURES
    ),
)
def l16(t):
    train, _ = _repeat_train(t)
    model = estimators.fit(estimators.logistic(REPEAT_FEATURES, TARGET), train, REPEAT_FEATURES, TARGET)
    found = estimators.importance(t.spark, model, REPEAT_FEATURES)
    return found.select("feature", (F.col("importance") >= 0).alias("valid"), "method")


def _repeat_champion(t):
    return repeat.CANDIDATES, *repeat.train_candidates(t.snapshot_table, repeat.CANDIDATES)


@query(
    "l17_repeat_champion",
    " UNION ALL ".join(
        f"SELECT '{m}' AS model, TRUE AS metrics_valid, 1 AS champions, TRUE AS champion_leads" for m in repeat.CANDIDATES
    ),
)
def l17(t):
    """Each candidate's metrics, all between 0 and 1; one champion, and none has a better validation AUC."""
    metrics_of = _repeat_champion(t)[1]
    best = metrics_of.agg(
        F.sum("selected_model_flag").alias("champions"),
        (F.max("validation_roc_auc") == F.max(F.expr("CASE WHEN selected_model_flag = 1 THEN validation_roc_auc END"))).alias("leads"),
    ).head()
    ranges = [F.col(c).between(0, 1) for c in ("validation_roc_auc", "roc_auc", "pr_auc", "accuracy", "f1")]
    valid = ranges[0] & ranges[1] & ranges[2] & ranges[3] & ranges[4]
    return metrics_of.select(
        "model", valid.alias("metrics_valid"), F.lit(best["champions"]).alias("champions"), F.lit(best["leads"]).alias("champion_leads")
    )


def _fx_names(t):
    return [c for c in market.columns_matching(t.fx_table) if c != market.TARGET]


@query(
    "l18_regime_comparison",
    " UNION ALL ".join(
        f"SELECT '{d}' AS regime_definition, '{m}' AS model, TRUE AS metrics_valid, TRUE AS beats_majority" for d in _DEFINITIONS for m in volatility.candidates([])
    ),
)
def l18(t):
    compared, fitted = volatility.compare_regimes(t.fx_table, _fx_names(t))
    floors = {d: _majority_f1(held) for (d, _), (_, _, held) in fitted.items()}
    floor = recode("regime_definition", floors)
    valid = F.col("accuracy").between(0, 1) & F.col("f1_macro").between(0, 1) & F.col("balanced_accuracy").between(0, 1)
    return compared.select("regime_definition", "model", valid.alias("metrics_valid"), (F.col("f1_macro") > floor).alias("beats_majority"))


@query(
    "l19_best_per_definition",
    " UNION ALL ".join(f"SELECT '{d}' AS regime_definition, TRUE AS leaders_known, TRUE AS ordered" for d in _DEFINITIONS),
)
def l19(t):
    """Both leaders of each definition, over all candidates."""
    compared, _ = volatility.compare_regimes(t.fx_table, _fx_names(t))
    both = volatility.definition_comparison(compared)
    models = list(volatility.candidates([]))
    return both.select(
        "regime_definition",
        (F.col("best_model_by_f1").isin(models) & F.col("best_model_by_balanced_accuracy").isin(models)).alias("leaders_known"),
        (
            (F.col("best_f1_macro") >= F.col("f1_macro_for_best_balanced_accuracy_model"))
            & (F.col("best_balanced_accuracy") >= F.col("balanced_accuracy_for_best_f1_model"))
        ).alias("ordered"),
    )


@query("l21_score_latest", _SCORED + "newest")
def l21(t):
    """The champion, refitted on train and validation (L20), scores the newest snapshot with its validation threshold."""
    candidates, metrics_of, fitted = _repeat_champion(t)
    name = repeat.champion(metrics_of)
    model = repeat.refit(candidates[name], t.snapshot_table, seen=fitted[name].seen)
    scored = repeat.score_latest(model, t.snapshot_table, fitted[name].threshold)
    return scored.select("user_id", "observation_date", TARGET, *_valid("repeat_probability", "predicted_repeat_30d"))


@query("l20_refit", _SCORED + "newest")
def l20(t):
    """A model refitted on train and validation together scores the newest snapshot."""
    model = repeat.refit(repeat.CANDIDATES["Logistic Regression"], t.snapshot_table)
    scored = repeat.score_latest(model, t.snapshot_table, 0.5)
    return scored.select("user_id", "observation_date", TARGET, *_valid("repeat_probability", "predicted_repeat_30d"))


_TEST = f"""(SELECT snaps.* FROM snaps, {_DATES} WHERE observation_date >= {_PART.format("0.85e0")})"""


@query(
    "l27_repeat_flow",
    """SELECT user_id, CAST(observation_date AS VARCHAR) AS observation_date, target_repeat_30d, recency_days, transactions_90d,
              total_volume_90d, value_segment, acquisition_channel, total_volume_90d * CAST(0.00025 AS DOUBLE) AS estimated_fee_proxy_90d,
              TRUE AS probability_valid, TRUE AS prediction_valid, TRUE AS segment_fits, TRUE AS risk_fits FROM target_a""",
)
def l27(t):
    """Champion, refit, newest scores and targeting in one flow; segments follow the fitted scores."""
    aimed = model_flows.repeat_flow(t.snapshot_table, user_context(t.mart))["user_repeat_targeting_dataset"]
    p, high = F.col("repeat_probability"), F.col("value_segment") == "High value"
    segment = F.when(p <= 0.35, "Low").when(p <= 0.7, "Medium").otherwise("High")
    at_risk = high & (p < 0.5)
    return aimed.select(
        "user_id", "observation_date", TARGET, "recency_days", "transactions_90d", "total_volume_90d", "value_segment",
        "acquisition_channel", "estimated_fee_proxy_90d", *_valid("repeat_probability", "predicted_repeat_30d"),
        (F.concat(segment, F.lit(" repeat probability")) == F.col("probability_segment")).alias("segment_fits"),
        ((F.col("risk_segment") == "High-value at-risk users") == at_risk).alias("risk_fits"),
    )


@query(
    "l28_champion_evaluation",
    f"""SELECT CASE target_repeat_30d WHEN 1 THEN 'Actual repeat' ELSE 'Actual no repeat' END AS actual, COUNT(*) AS cases,
               TRUE AS report_agrees, TRUE AS beats_chance FROM {_TEST} GROUP BY 1""",
)
def l28(t):
    """The champion's confusion matrix on the test part, its report by class, and its area over a guess on the validation part."""
    metrics_of, fitted = repeat.train_candidates(t.snapshot_table)
    test = model_flows.judged(fitted[repeat.champion(metrics_of)], t.snapshot_table)
    no, yes = (F.col(f"Predicted {n}") for n in model_flows.OUTCOMES)
    matrix = metrics.confusion(test, TARGET, "predicted", [0, 1], model_flows.OUTCOMES)
    report = metrics.classification_report(test, TARGET, "predicted", ["0", "1"]).where("class IN ('0', '1')")
    named = report.withColumn("actual", F.when(F.col("class") == "1", "Actual repeat").otherwise("Actual no repeat"))
    right = F.when(F.col("actual") == "Actual repeat", yes).otherwise(no)
    agrees = (F.col("support") == no + yes) & (F.abs(F.col("recall") * F.col("support") - right) < 1e-6)
    learnt = metrics_of.agg(F.max("validation_roc_auc") > 0.5).scalar()
    return matrix.join(named, "actual").select("actual", (no + yes).alias("cases"), agrees.alias("report_agrees"), learnt.alias("beats_chance"))


def _majority_f1(held) -> float:
    """Macro F1 of a guess that always names the held-out dates' most frequent regime: the best that no model gives."""
    counts = [r["count"] for r in held.groupBy("actual_regime").count().collect()]
    share = max(counts) / sum(counts)
    return 2 * share / (1 + share) / len(volatility.CLASSES)


def _valid_predictions(shown):
    shown = staged(shown, "regime-predictions")
    found = metrics.class_metrics(shown, "actual_regime", "predicted_regime", volatility.CLASSES)
    learnt = found.select(F.col("f1_macro") > _majority_f1(shown)).scalar()
    shares = [F.col(f"prob_{c}") for c in volatility.CLASSES]
    total = F.abs(shares[0] + shares[1] + shares[2] - 1) < 1e-9
    inside = shares[0].between(0, 1) & shares[1].between(0, 1) & shares[2].between(0, 1)
    return shown.select(
        "date", (total & inside).alias("probabilities_valid"), F.col("predicted_regime").isin(*volatility.CLASSES).alias("regime_valid"),
        learnt.alias("beats_majority"),
    )


@query("l22_regime_predictions", _TEST_DATES)
def l22(t):
    """The champion of all candidates and definitions predicts the held-out dates."""
    names = _fx_names(t)
    compared, fitted = volatility.compare_regimes(t.fx_table, names)
    first = compared.where("selected_model_flag = 1").head()
    _, model, held = fitted[first["regime_definition"], first["model"]]
    return _valid_predictions(volatility.predictions(model, held, names))


@query(
    "l23_regime_metadata",
    f"""WITH {_THREE_MEANS},
        q AS (SELECT quantile_cont(target_next_abs_return, 0.33) AS lo, quantile_cont(target_next_abs_return, 0.67) AS hi
              FROM w WHERE i < floor(n * 0.8e0)),
        d AS (SELECT CAST(MAX("date") FILTER (WHERE i < floor(n * 0.8e0)) AS VARCHAR) AS train_end,
                     CAST(MIN("date") FILTER (WHERE i >= floor(n * 0.8e0)) AS VARCHAR) AS test_start FROM w)
        SELECT '{_DEFINITIONS[0]}' AS regime_definition, 'train_quantile' AS method, {rnd("lo", 10)} AS low_threshold, {rnd("hi", 10)} AS high_threshold,
               NULL AS cluster_centers, NULL AS regimes, train_end, test_start, 'lineitem' AS data_provider FROM q, d
        UNION ALL SELECT '{_DEFINITIONS[1]}', 'train_kmeans_1d_abs_return', NULL, NULL, printf('%.8f, %.8f, %.8f', c1, c2, c3), 'high,low,normal',
               train_end, test_start, 'lineitem' FROM means, d""",
)
def l23(t):
    """Constants of both definitions; cluster numbers depend on the start, so centres come by size and regimes by name."""
    train, test = splits.split_by_position(t.fx_table)
    fitted = [volatility.quantile_regimes(train), volatility.kmeans_regimes(train)]
    found = volatility.regime_metadata(train, test, fitted, "lineitem")
    centers = F.array_join(F.array_sort(F.split("cluster_centers", ", ")), ", ")
    names = F.array_join(F.array_sort(F.regexp_extract_all("cluster_to_regime", F.lit("'([a-z]+)'"), F.lit(1))), ",")
    return found.withColumns(
        {"cluster_centers": centers, "regimes": names, **{c: round_half_up(c, 10) for c in ("low_threshold", "high_threshold")}}
    ).drop("cluster_to_regime")


@query("l24_mlp", _TEST_DATES)
def l24(t):
    names = _fx_names(t)
    train, test = splits.split_by_position(t.fx_table)
    regimes = volatility.quantile_regimes(train)
    model = estimators.fit(estimators.mlp(names, volatility.LABEL), volatility.with_regime(train, regimes), names, volatility.LABEL)
    return _valid_predictions(volatility.predictions(model, volatility.with_regime(test, regimes), names))


@query("l26_softmax_boosting", _TEST_DATES)
def l26(t):
    """Boosted trees for three classes, with shares that sum to one."""
    names = _fx_names(t)
    train, test = splits.split_by_position(t.fx_table)
    regimes = volatility.quantile_regimes(train)
    model = estimators.fit(volatility.softmax_boosted(names), volatility.with_regime(train, regimes), names, volatility.LABEL)
    return _valid_predictions(volatility.predictions(model, volatility.with_regime(test, regimes), names))


@query("s11_model_bundle", f"SELECT COUNT(*) AS rows, 0 AS mismatches FROM {_VALIDATION}")
def s11(t):
    """Save a fitted pipeline with its description, load it, and score with both."""
    train, validation = _repeat_train(t)
    model = estimators.fit(estimators.logistic(REPEAT_FEATURES, TARGET), train, REPEAT_FEATURES, TARGET)
    path = f"{shared_dir(t.spark)}/repeat-model-{uuid.uuid4().hex}"
    meta = {"features": REPEAT_FEATURES, "threshold": 0.5, "observation_window_days": 90, "prediction_window_days": 30}
    estimators.save_model(model, path, meta)
    loaded, described = estimators.load_model(path)
    kept = estimators.score(model, validation, REPEAT_FEATURES).withColumnRenamed("probability_1", "kept").drop("prediction")
    both = estimators.score(loaded, kept, described["features"])
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("kept") != F.col("probability_1")).alias("mismatches"))

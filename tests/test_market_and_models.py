from __future__ import annotations

import math
import threading
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from helpers import rows
from pyspark.sql import functions as F

from tidemark.models import estimators, metrics, repeat, splits, volatility
from tidemark.operators import market, snapshots


def series(spark, days, gaps=()):
    """Two pairs; ``gaps`` are (pair, position) without a row."""
    out = []
    for p, scale in (("M", 1.0), ("O", 3.0)):
        for i in range(days):
            if (p, i) in gaps:
                continue
            close = scale * (100 + 5 * math.sin(i / 3) + (i % 7))
            out.append((p, date(2024, 1, 1) + timedelta(i), close - 1, close + 2, close - 2, close))
    return spark.createDataFrame(out, "pair string, date date, open double, high double, low double, close double")


def test_features_against_pandas(spark):
    fx = series(spark, 60, {("O", 30), ("M", 10)})
    got = market.fx_features(fx, "M", ["M", "O"]).orderBy("date").toPandas().set_index("date")
    wide = fx.groupBy("date").pivot("pair").agg(F.first("close")).toPandas().set_index("date").sort_index().dropna(subset=["M"])
    want = pd.DataFrame(index=wide.index)
    for p in ("M", "O"):
        c = wide[p].astype(float)
        r = np.log(c).diff()
        want[f"{p}_return_1d"] = c.pct_change(fill_method=None)
        want[f"{p}_log_return_1d"] = r
        for w in (5, 10, 20):
            want[f"{p}_vol_{w}d"] = r.rolling(w).std() * np.sqrt(252)
            want[f"{p}_momentum_{w}d"] = c / c.shift(w) - 1
        want[f"{p}_ma_gap_5_20"] = c.rolling(5).mean() / c.rolling(20).mean() - 1
    want["target_next_abs_return"] = np.log(wide["M"]).diff().abs().shift(-1)
    want["M_intraday_range_pct"] = 4.0 / wide["M"]
    want = want.dropna()
    assert list(got.index) == list(want.index) and len(got) > 5
    for c in want.columns:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-12, err_msg=c)
    assert len(market.columns_matching(market.fx_features(fx, "M", ["M", "O"]))) == 9 * 2 + 1


def test_short_series_gives_no_rows(spark):
    assert market.fx_features(series(spark, 15), "M", ["M", "O"]).count() == 0


def test_alignment_and_pair_filter(spark):
    fx = series(spark, 10, {("M", 4), ("O", 5)})
    wide = market.align_pairs(fx, "M", ["M", "O"])
    assert wide.count() == 9 and wide.where("O_close IS NULL").count() == 1
    assert market.align_pairs(fx, "M", ["M", "O"], ["close"]).columns == ["date", "M_close", "O_close"]
    more = fx.where("pair = 'M' OR date < '2024-01-04'")
    assert {r["pair"] for r in market.filter_pairs(more, 5).collect()} == {"M"}


def scored(spark, data):
    return spark.createDataFrame(data, "y int, p double")


def brute_auc(data):
    pos = [p for y, p in data if y == 1]
    neg = [p for y, p in data if y == 0]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def brute_ap(data):
    total = sum(y for y, _ in data)
    out, before = 0.0, 0.0
    for t in sorted({p for _, p in data}, reverse=True):
        hit = [y for y, p in data if p >= t]
        recall = sum(hit) / total
        out += (recall - before) * sum(hit) / len(hit)
        before = recall
    return out


def brute_threshold(data):
    best = None
    for t in sorted({p for _, p in data}):
        tp = sum(1 for y, p in data if p >= t and y == 1)
        f1 = 2 * tp / (sum(1 for _, p in data if p >= t) + sum(y for y, _ in data))
        if best is None or f1 > best[1] + 1e-15:
            best = (t, f1)
    return best


@pytest.mark.parametrize("ranges", [1, 5])
@pytest.mark.parametrize("step", [3, 50])
def test_score_curves_against_brute_force(spark, ranges, step):
    rng = np.random.default_rng(3)
    data = [(int(rng.random() < 0.2 + 0.6 * (i % step) / step), (i % step) / step) for i in range(240)]
    df = scored(spark, data)
    assert metrics.roc_auc(df, "y", "p", ranges).head()[0] == pytest.approx(brute_auc(data), abs=1e-12)
    assert metrics.average_precision(df, "y", "p", ranges).head()[0] == pytest.approx(brute_ap(data), abs=1e-12)
    t, f1 = brute_threshold(data)
    got = metrics.best_f1_threshold(df, "y", "p", ranges).head()
    assert got["threshold"] == t and got["f1"] == pytest.approx(f1, abs=1e-12)
    both = metrics.score_curves(df, "y", "p", ranges).head()
    assert both["roc_auc"] == pytest.approx(brute_auc(data), abs=1e-12) and both["threshold"] == t


def test_curves_with_one_class(spark):
    df = scored(spark, [(1, 0.2), (1, 0.4)])
    assert metrics.roc_auc(df, "y", "p").head()[0] is None
    assert metrics.average_precision(df, "y", "p").head()[0] == pytest.approx(1.0)


def test_class_never_predicted(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "y string, h string")
    macro = metrics.class_metrics(df, "y", "h", ["a", "b", "c"]).head()
    assert macro["precision_macro"] == pytest.approx((0.5 + 0 + 1) / 3)
    assert macro["balanced_accuracy"] == pytest.approx(2 / 3)
    assert rows(metrics.confusion(df, "y", "h", ["a", "b", "c"]))[1] == ("Actual b", 1, 0, 0)
    report = {r["class"]: r for r in metrics.classification_report(df, "y", "h", ["a", "b", "c"]).collect()}
    assert report["b"]["f1-score"] == 0.0 and report["macro avg"]["support"] == 3.0


def test_published_confusion_gives_published_metrics(spark):
    """Counts of the published confusion matrix reproduce the published report."""
    cells = [(0, 0, 20952), (0, 1, 15636), (1, 0, 5506), (1, 1, 22748)]
    df = spark.createDataFrame([(y, h, n) for y, h, n in cells], "y int, h int, n int")
    df = df.select("y", "h", F.explode(F.sequence(F.lit(1), "n")))
    got = metrics.class_metrics(df, "y", "h", ["0", "1"], "1").head()
    assert got["precision"] == pytest.approx(0.592642767819925)
    assert got["recall"] == pytest.approx(0.8051249380618674)
    assert got["f1"] == pytest.approx(0.6827335754374381)


def test_splits(spark):
    data = [(date(2024, 1, 1) + timedelta(i), k) for i in range(20) for k in range(3)]
    df = spark.createDataFrame(data, "observation_date date, k int")
    train, validation, test = splits.split_by_dates(df)
    assert [p.count() for p in (train, validation, test)] == [42, 9, 9]
    assert train.agg(F.max("observation_date")).head()[0] < validation.agg(F.min("observation_date")).head()[0]
    before, after = splits.split_at(df, "observation_date", date(2024, 1, 5))
    assert (before.count(), after.count()) == (15, 45)
    one = df.where("k = 0").withColumnRenamed("observation_date", "date")
    first, rest = splits.split_by_position(one)
    assert (first.count(), rest.count()) == (16, 4)


@pytest.fixture(scope="module")
def snaps(spark):
    start = date(2024, 1, 31)
    rng = np.random.default_rng(1)
    data = []
    for m in range(10):
        for u in range(60):
            n = int(rng.integers(0, 6))
            y = int(rng.random() < 0.15 + 0.12 * n)
            data.append((u, start + timedelta(31 * m), int(rng.integers(0, 90)), n, n, float(n * 100), float(rng.random() / 2), y))
    return spark.createDataFrame(
        data,
        "user_id long, observation_date date, recency_days int, transactions_90d long, transactions_all long, "
        "total_volume_90d double, failed_ratio_90d double, target_repeat_30d int",
    ).persist()


def test_repeat_models(spark, snaps, tmp_path):
    small = {
        "Logistic Regression": repeat.CANDIDATES["Logistic Regression"],
        "Random Forest": lambda: estimators.forest(snapshots.REPEAT_FEATURES, snapshots.TARGET, trees=5, depth=3, min_leaf=5),
    }
    table, fitted = repeat.train_candidates(snaps, small)
    got = table.collect()
    assert sum(r["selected_model_flag"] for r in got) == 1 and all(0.5 < r["roc_auc"] <= 1 for r in got)
    name = repeat.champion(table)
    best = max(got, key=lambda r: (r["validation_roc_auc"], r["validation_pr_auc"]))
    assert best["model"] == name
    model = repeat.refit(small["Logistic Regression"], snaps)
    out = repeat.score_latest(model, snaps, fitted[name].threshold)
    assert out.count() == 60 and out.where("repeat_probability NOT BETWEEN 0 AND 1").count() == 0
    estimators.save_model(model, str(tmp_path / "m"), {"threshold": 0.4})
    loaded, meta = estimators.load_model(str(tmp_path / "m"))
    again = repeat.score_latest(loaded, snaps, meta["threshold"])
    assert rows(again.select("user_id", "repeat_probability")) == rows(out.select("user_id", "repeat_probability"))
    ranked = estimators.importance(spark, model, snapshots.REPEAT_FEATURES).collect()
    assert len(ranked) == 4 and ranked[0]["importance"] >= ranked[-1]["importance"]


def test_weights_and_majority(spark, snaps):
    weights = estimators.class_weights(snaps, "target_repeat_30d")
    n = {r[0]: r[1] for r in snaps.groupBy("target_repeat_30d").count().collect()}
    assert weights[1.0] == pytest.approx(600 / (2 * n[1]))
    assert estimators.positive_weight(snaps, "target_repeat_30d") == pytest.approx(n[0] / n[1])
    guess = estimators.majority(snaps, snaps, "target_repeat_30d").select("prediction").distinct().collect()
    assert [r[0] for r in guess] == [max(n, key=n.get)]


def test_regimes(spark):
    values = [0.1] * 10 + [0.5] * 10 + [0.9] * 10
    df = spark.createDataFrame([(v,) for v in values], "target_next_abs_return double")
    by_center = volatility.kmeans_regimes(df, starts=3)
    assert sorted(by_center.centers) == pytest.approx([0.1, 0.5, 0.9])
    named = volatility.with_regime(df, by_center).groupBy("actual_regime").count()
    assert rows(named) == [("high", 10), ("low", 10), ("normal", 10)]
    fixed = volatility.Regimes("q", "m", 0.1, 0.9)
    assert [r[0] for r in df.select(fixed.label().alias("r")).distinct().orderBy("r").collect()] == ["low", "normal"]
    fixed.upper_is_high = True
    assert "high" in {r[0] for r in df.select(fixed.label()).collect()}
    assert sorted(by_center.cluster_to_regime.values()) == ["high", "low", "normal"]


def test_regime_comparison(spark):
    fx = series(spark, 140)
    wide = market.fx_features(fx, "M", ["M", "O"]).persist()
    names = [c for c in market.columns_matching(wide) if c != market.TARGET]
    quick = {"Logistic Regression": lambda: estimators.logistic(names, volatility.LABEL, max_iter=20)}
    compared, fitted = volatility.compare_regimes(
        wide, names, (volatility.quantile_regimes, lambda t: volatility.kmeans_regimes(t, starts=2)), quick
    )
    assert compared.count() == 2 and compared.where("selected_model_flag = 1").count() == 1
    assert volatility.best_per_definition(compared).count() == 2
    assert volatility.definition_comparison(compared).count() == 2
    (regimes, model, held) = next(iter(fitted.values()))
    out = volatility.predictions(model, held, names)
    assert {"prob_low", "prob_normal", "prob_high", "recommended_action"} <= set(out.columns)
    train, test = splits.split_by_position(wide)
    meta = volatility.regime_metadata(train, test, [regimes], "files").head()
    assert meta["train_end"] < meta["test_start"]


def test_fitted_forest_does_not_depend_on_the_partitions(spark, snaps):
    """The same rows in one file part or in seven, in any order, give the same model."""
    probabilities = []
    for parts in (1, 7):
        make = estimators.forest(snapshots.REPEAT_FEATURES, snapshots.TARGET, trees=5, depth=3, min_leaf=5)
        model = estimators.fit(make, snaps.repartition(parts), snapshots.REPEAT_FEATURES, snapshots.TARGET)
        found = estimators.score(model, snaps, snapshots.REPEAT_FEATURES)
        probabilities.append(rows(found.select("user_id", "observation_date", "probability_1")))
    assert probabilities[0] == probabilities[1]


def test_equal_rows_are_merged_with_all_their_weight(spark):
    """A tree learner's rows are as many as ``MERGED`` for each cell of bins, however many rows fall in it."""
    df = spark.sql(f"SELECT 1.0D AS a, 0.0D AS y, 2.0D AS {estimators.WEIGHT} FROM range(5000) UNION ALL SELECT 2.0D, 1.0D, 0.5D FROM range(3)")
    merged = estimators.merged_rows(df, ["a", "y"])
    found = {r["a"]: (r["rows"], r["weight"]) for r in merged.groupBy("a").agg(F.count("a").alias("rows"), F.sum(estimators.WEIGHT).alias("weight")).collect()}
    assert found[2.0] == (3, 1.5)
    assert found[1.0][0] == estimators.MERGED and found[1.0][1] == pytest.approx(10_000)


def test_bins_keep_few_values_apart_and_cut_many_at_quantiles(spark):
    df = spark.sql("SELECT IF(id % 100 < 90, 0.0D, id % 5 + 0.0D) AS few, CAST(id AS DOUBLE) AS many, 1.0D AS one FROM range(4000)")
    model = estimators.Bins(["few", "many", "one"], ["f", "m", "o"], 8).fit(df)
    rows = model.transform(df)
    assert rows.select("few", "f").distinct().count() == rows.select("f").distinct().count() == 5
    sizes = [r["count"] for r in rows.groupBy("m").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 520
    assert rows.select("o").distinct().count() == 1


@pytest.mark.parametrize("make", [estimators.forest, estimators.boosted])
def test_trees_of_merged_rows_learn_and_take_new_values(spark, make):
    df = spark.sql("SELECT CAST(id % 1000 AS DOUBLE) AS a, IF(id % 7 = 0, NULL, id % 3 + 0.0D) AS b, IF(id % 1000 >= 700, 1, 0) AS y FROM range(20000)")
    some = {"trees": 5} if make is estimators.forest else {"rounds": 5}
    model = estimators.fit(make(["a", "b"], "y", depth=3, **some), df, ["a", "b"], "y", single=1000)
    assert len(model.stages) == 4
    new = spark.createDataFrame([(-50.0, 9.0), (100.0, None), (1e9, 0.0), (900.0, 1.0)], "a double, b double")
    assert [r["prediction"] for r in estimators.score(model, new, ["a", "b"]).collect()] == [0.0, 0.0, 1.0, 1.0]


def test_candidates_are_fitted_side_by_side(spark):
    """Each waits for the other to begin."""
    meet = threading.Barrier(2, timeout=60)
    rows = [(u, date(2024, m, 28), u % 2 * 5 + m % 3, u % 5, 1.0 * u, 0.1, u % 2) for u in range(20) for m in range(1, 11)]
    names = "user_id long, observation_date date, recency_days int, transactions_90d long, total_volume_90d double, failed_ratio_90d double, target_repeat_30d int"

    def make():
        meet.wait()
        return estimators.logistic(snapshots.REPEAT_FEATURES, snapshots.TARGET, max_iter=5)

    found, fitted = repeat.train_candidates(spark.createDataFrame(rows, names), {"one": make, "two": make})
    assert list(fitted) == ["one", "two"] and [r["model"] for r in found.collect()] == ["one", "two"]


def many_rows(spark):
    """Some 86 different rows, each up to ten times, with missing values."""
    return spark.sql(
        "SELECT IF(k % 11 = 0, NULL, k % 9 + 0.5D) AS a, IF(k % 13 = 0, DOUBLE('NaN'), k % 7 * 100.0D) AS b, IF((k * 37) % 90 < k, 1, 0) AS y "
        "FROM (SELECT id % 90 AS k, id FROM range(900)) WHERE id < 90 * (1 + k % 10)"
    )


def test_equal_rows_reach_the_regression_once_with_all_their_weight(spark):
    """Above ``single`` rows the learner sees different rows alone, and fits, fills and scales as on single rows."""
    df, names = many_rows(spark), ["a", "b"]
    plain = estimators.fit(estimators.logistic(names, "y"), df, names, "y")
    merged = estimators.fit(estimators.logistic(names, "y"), df, names, "y", single=10)
    assert plain.stages[-1].summary.predictions.count() == df.count() > 400
    assert merged.stages[-1].summary.predictions.count() == df.distinct().count() == 86
    assert merged.stages[-1].coefficients.toArray() == pytest.approx(plain.stages[-1].coefficients.toArray(), rel=1e-5)
    assert rows(merged.stages[0].surrogateDF) == rows(plain.stages[0].surrogateDF)
    for part in ("mean", "std"):
        assert getattr(merged.stages[2], part).toArray() == pytest.approx(getattr(plain.stages[2], part).toArray(), rel=1e-12)


def test_learners_without_weights_keep_single_rows(spark):
    df, names = many_rows(spark), ["a", "b"]
    model = estimators.fit(estimators.logistic(names, "y", weighted=False), df, names, "y", single=10)
    assert model.stages[-1].summary.predictions.count() == df.count()


@pytest.mark.parametrize("make", [estimators.forest, estimators.boosted])
def test_cells_of_bins_are_scored_for_all_their_rows(spark, make):
    """Scores by cell are the model's own, for each row and counted; no row is lost."""
    df, names = many_rows(spark), ["a", "b"]
    some = {"trees": 4} if make is estimators.forest else {"rounds": 3}
    model = estimators.fit(make(names, "y", depth=3, **some), df, names, "y", single=10)
    own = model.transform(df).select("y", F.col("prediction"), estimators.vector_to_array("probability")[1].alias("p"))
    shown = estimators.score(model, df, names)
    assert shown.columns == ["a", "b", "y", "probability_1", "prediction"]
    assert "UDF" not in shown._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert rows(shown.select("y", "prediction", "probability_1")) == rows(own)
    counted = estimators.score_counts(model, estimators.equal_rows(df, names, "y"), "y")
    want = {(r["y"], r["p"]): r["count"] for r in own.groupBy("y", "p").count().collect()}
    assert {(r["y"], r["probability_1"]): r[estimators.ROWS] for r in counted.collect()} == want


def test_candidates_of_merged_rows_are_measured_over_all_rows(spark, snaps):
    """The regression's measures are those of single rows; a refit on rows at hand is a refit on the parts."""
    twice = snaps.unionByName(snaps.where("user_id % 3 = 0"))
    one = {"Logistic Regression": repeat.CANDIDATES["Logistic Regression"]}
    merged, fitted = repeat.train_candidates(twice, one, single=10)
    plain, _ = repeat.train_candidates(twice, one)
    got, want = merged.head().asDict(), plain.head().asDict()
    assert all(got[c] == pytest.approx(want[c], rel=1e-6) for c in got if not isinstance(got[c], str))
    train, validation, test = splits.split_by_dates(twice)
    whole = estimators.score(fitted["Logistic Regression"].model, test, snapshots.REPEAT_FEATURES)
    decided = metrics.class_metrics(repeat.decide(whole, got["decision_threshold"]), snapshots.TARGET, "predicted", ["0", "1"], "1").head()
    assert (decided["accuracy"], decided["f1"]) == (got["accuracy"], got["f1"])
    seen = fitted["Logistic Regression"].seen
    assert seen.agg(F.sum(estimators.ROWS)).head()[0] == train.count() + validation.count() > seen.count()
    again = [repeat.refit(one["Logistic Regression"], twice, seen=s).stages[-1].coefficients.toArray() for s in (seen, None)]
    assert again[0] == pytest.approx(again[1], rel=1e-9)


def test_kept_places_give_the_same_forest(spark, snaps, monkeypatch):
    """Keeping rows' places in the trees, or walking the trees at every level: a matter of time alone."""
    make = estimators.forest(snapshots.REPEAT_FEATURES, snapshots.TARGET, trees=5, depth=4, min_leaf=5)
    kept = estimators.fit(make, snaps, snapshots.REPEAT_FEATURES, snapshots.TARGET).stages[-1]
    monkeypatch.setattr(estimators, "KEPT_PLACES", 0)
    walked = estimators.fit(make, snaps, snapshots.REPEAT_FEATURES, snapshots.TARGET).stages[-1]
    assert kept.getCacheNodeIds() and not walked.getCacheNodeIds()
    assert kept.toDebugString.split("\n")[1:] == walked.toDebugString.split("\n")[1:]

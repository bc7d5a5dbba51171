"""Every registered query against its SQL statement, value for value, and the driver contract."""

from __future__ import annotations

import importlib
import os
import re
from pathlib import Path

import pytest
from compare import compare, connect

from tidemark import registry

DATA = os.environ.get("TIDEMARK_TEST_DATA", "/root/testdata/sf0.001")
QUERIES, SQL = registry.queries(), registry.oracle_sql()
# Market models need the unbroken daily series of the next larger data folder.
LARGER = "/root/testdata/sf0.01"
# Many model fits each; run by tests/compare.py, and their parts by test_market_and_models.py.
LONG = {"l5_forest", "l6_boosted", "l17_repeat_champion", "l18_regime_comparison", "l19_best_per_definition", "l21_score_latest", "l22_regime_predictions", "l24_mlp", "l27_repeat_flow", "l28_champion_evaluation"}

pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


FITTED = ["l16_importance", "l20_refit", "l23_regime_metadata", "l26_softmax_boosting", "l3_logistic", "l8_kmeans_regimes", "s11_model_bundle"]


@pytest.mark.parametrize("name", FITTED)
def test_fitted_models_match_sql(spark, name):
    ok, note = compare(spark, connect(LARGER), LARGER, QUERIES[name], SQL[name])
    assert ok, note


@pytest.mark.parametrize("name", sorted(set(SQL) - LONG - set(FITTED)))
def test_matches_sql(spark, duck, name):
    ok, note = compare(spark, duck, DATA, QUERIES[name], SQL[name])
    assert ok, note


def test_contract(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(re.fullmatch(r"[a-z][a-z0-9_]*", n) for n in entry.queries())


def test_no_cross_joins_or_row_caps():
    source = "\n".join(p.read_text() for p in Path(registry.__file__).parents[1].rglob("*.py"))
    for banned in ("crossJoin", "localCheckpoint", ".sample(", "toPandas", "rdd."):
        assert banned not in source, banned


@pytest.mark.parametrize("name", ["m2_user_lifecycle", "a7_d30_by_channel", "a14_cohort_retention", "m7_build_snapshots", "q7_tx_before_signup"])
def test_plans_stay_parallel(spark, name):
    """No nested-loop join, no ordering of rows in a single task."""
    df = QUERIES[name](spark, DATA)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    for below in text.split("Exchange SinglePartition")[1:]:
        assert "HashAggregate" in below.split("\n")[1]


def test_boosting_takes_all_rounds(spark, monkeypatch):
    from tidemark.registry import modelling

    def rounds(pipeline):
        return pipeline.getStages()[-1].getMaxIter()

    monkeypatch.setattr(modelling, "_scored_sample", lambda t, pipeline: rounds(pipeline))
    monkeypatch.setattr(modelling.repeat, "train_candidates", lambda snapshots, candidates: (candidates, None))
    tables = type("Tables", (), {"snapshot_table": None})
    candidates, measured, _ = modelling._repeat_champion(tables)
    assert modelling.l6(tables) == 180
    assert all(rounds(c["Gradient Boosted Trees"]()) == 180 for c in (candidates, measured))

from __future__ import annotations

import pytest
from helpers import events, plan, rows, ts, tx, users
from pyspark.sql import functions as F

from tidemark.operators import cleaning, funnel, joins, lifecycle, repeat, retention, value


def test_dedupe_keeps_lowest_id_and_groups_nulls(spark):
    df = events(
        spark,
        [
            (5, 1, "s", "2024-01-01T00:00:00", "view"),
            (2, 1, "s", "2024-01-01T00:00:00", "view"),
            (3, 1, None, "2024-01-01T00:00:00", "view"),
            (4, 1, None, "2024-01-01T00:00:00", "view"),
            (9, 1, "s", "2024-01-01T00:00:01", "view"),
        ],
    )
    assert sorted(r["event_id"] for r in cleaning.dedupe_by_key(df).collect()) == [2, 3, 9]
    assert tuple(cleaning.dedupe_report(df).head()) == (5, 3, 2)
    assert tuple(cleaning.dedupe_report(df.limit(0)).head()) == (0, 0, 0)


def test_dedupe_limits_before_the_shuffle(spark):
    df = events(spark, [(i, 1, "s", "2024-01-01T00:00:00", "view") for i in range(50)])
    text = plan(cleaning.dedupe_by_key(df))
    assert "WindowGroupLimit" in text and "Partial" in text.split("Exchange")[-1]


@pytest.fixture(scope="module")
def mart(spark):
    s = "2024-01-01T08:00:00"
    people = users(
        spark,
        [
            (1, s, "direct", s, s),  # exactly at the limit
            (2, s, "direct", s, s),  # a second late
            (3, s, "direct", s, s),  # half a second late: same whole second
            (4, s, "other", None, None),  # exchange without KYC
            (5, s, "other", s, None),  # no transactions
            (6, s, "other", s, None),  # exchange without bank link
        ],
    )
    trades = tx(
        spark,
        [
            (1, "2024-01-15T08:00:00", {"order": "target_rate", "amount": 10.0}),
            (1, "2024-01-20T08:00:00", {"amount": 20.0}),
            (1, "2024-01-02T08:00:00", {"status": "failed"}),
            (1, "2024-01-02T08:00:00", {"type": "deposit"}),
            (2, "2024-01-15T08:00:01"),
            (3, "2024-01-15T08:00:00.500000"),
            (4, "2024-01-03T08:00:00"),
            (6, "2024-01-03T08:00:00"),
        ],
    )
    seen = events(spark, [(1, 1, "s", s, "rate_alert_created"), (2, 1, "s", s, "rate_alert_created"), (3, 2, "s", s, "view")])
    return lifecycle.user_lifecycle(people, trades, seen)


def test_lifecycle(mart):
    got = {r["user_id"]: r for r in mart.collect()}
    assert [got[u]["activation_flag"] for u in range(1, 7)] == [1, 0, 1, 0, 0, 0]
    assert [got[u]["onboarding_valid_flag"] for u in range(1, 7)] == [1, 1, 1, 0, 1, 1]
    one = got[1]
    assert (one["successful_transaction_count"], one["successful_transaction_volume"]) == (2, 30.0)
    assert (one["target_rate_user_flag"], one["rate_alert_user_flag"]) == (1, 1)
    assert (one["activation_days_exact"], one["activation_hours"], one["days_to_kyc"]) == (14.0, 336.0, 0.0)
    five = got[5]
    assert (five["successful_transaction_count"], five["successful_transaction_volume"]) == (0, 0.0)
    assert five["activation_days_exact"] is None


def test_funnel_forms(mart):
    wide = funnel.funnel(mart)
    assert tuple(wide.head()) == (5, 5, 3, 4, 2)
    steps = rows(funnel.prev_step_rate(funnel.stage_rate(funnel.funnel_long(wide))))
    assert steps[3][1:] == ("First successful exchange", 4, 80.0, 133.33)
    assert steps[0][-1] is None
    by = funnel.funnel(mart, by=["acquisition_channel"])
    assert sum(r["valid_signups"] for r in by.collect()) == 5
    assert [r["activation_rate_14d"] for r in by.collect()] == [66.67, 0.0]
    assert sum(r["valid_signups"] for r in funnel.monthly_trend(mart).collect()) == 5


def test_funnel_of_nothing(mart):
    assert tuple(funnel.funnel(mart.where("user_id < 0")).head()) == (0, None, None, None, None)


def test_feature_adoption_is_one_scan(mart):
    got = rows(funnel.feature_adoption(mart))
    assert got == [("rate_alert", 1, 5, 20.0), ("target_rate_order", 1, 5, 20.0)]


@pytest.fixture(scope="module")
def trades(spark):
    first = "2024-01-01T10:00:00"
    return tx(
        spark,
        [
            (1, first), (1, first),  # same instant only
            (2, first), (2, "2024-01-31T10:00:00"),  # exactly 30 days
            (3, first), (3, "2024-01-31T10:00:01"),  # one second late
            (4, first), (4, "2024-01-01T10:00:00.900000"),  # same whole second
            (5, first), (5, "2024-01-05T10:00:00", {"status": "failed"}),
            (6, first), (6, "2024-06-05T10:00:00"), (6, "2024-01-02T10:00:00"),
        ],
    )


def test_repeat_within_boundaries(spark, trades):
    got = {r["user_id"]: r["d30_repeat_flag"] for r in repeat.repeat_within(trades).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 0, 5: 0, 6: 1}
    cut = F.lit("2024-01-20").cast("timestamp_ntz")
    assert all(r["d30_repeat_flag"] is None for r in repeat.repeat_within(trades, censor_after=cut).collect())


def test_repeat_equals_the_join_form_under_repartitioning(spark, trades):
    anchors = repeat.first_time(trades).withColumnRenamed("first_transaction_at", "start")
    inside = joins.within_join(
        lifecycle.successful(trades), anchors, "user_id", "transaction_timestamp", "start",
        F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0.9).cast("decimal(8,6)")), F.make_dt_interval(F.lit(30)),
    )
    by_join = {r["user_id"] for r in inside.select("user_id").distinct().collect()}
    shuffled = repeat.repeat_within(trades.repartition(11, "transaction_timestamp"))
    assert by_join == {r["user_id"] for r in shuffled.where("d30_repeat_flag = 1").collect()}


def test_repeat_keeps_two_rows_per_user_before_the_shuffle(trades):
    assert "WindowGroupLimit" in plan(repeat.repeat_within(trades))


def test_support_groups(spark, mart):
    flags = spark.createDataFrame([(i, i % 2) for i in range(1, 7)], "user_id long, d30_repeat_flag int")
    tickets = spark.createDataFrame(
        [(1, 1, 2.0, 4.0), (2, 2, 1.0, 5.0), (3, 2, 3.0, None)],
        "ticket_id long, user_id long, resolution_time_hours double, satisfaction_score double",
    )
    got = [tuple(r) for r in repeat.support_impact(mart, flags, tickets).collect()]
    assert got == [
        ("No support ticket", 2, 1, 50.0, None, None),
        ("One support ticket", 1, 1, 100.0, 2.0, 4.0),
        ("Multiple support tickets", 1, 0, 0.0, 2.0, 5.0),
    ]


def test_cohorts(spark):
    trades = tx(
        spark,
        [
            (1, "2023-12-05T00:00:00"), (1, "2024-02-01T00:00:00"), (1, "2024-02-09T00:00:00"),  # skips January
            (2, "2023-12-31T23:59:59"), (2, "2024-01-01T00:00:00"),  # year boundary
            (3, "2024-01-01T00:00:00"),  # a cohort of one
        ],
    )
    got = [tuple(map(str, r)) for r in retention.cohort_retention(trades).collect()]
    assert got == [
        ("2023-12-01", "0", "2", "2", "100.0"),
        ("2023-12-01", "1", "2", "1", "50.0"),
        ("2023-12-01", "2", "2", "1", "50.0"),
        ("2024-01-01", "0", "1", "1", "100.0"),
    ]
    weighted = [tuple(r) for r in retention.weighted_retention(retention.cohort_retention(trades)).collect()]
    assert weighted[0] == (0, 3, 3, 100.0)
    matrix = retention.cohort_matrix(retention.cohort_retention(trades), 1, 2, tail=1)
    assert [tuple(map(str, r)) for r in matrix.collect()] == [("2023-12-01", "50.0", "50.0")]
    valid = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "user_id long, onboarding_valid_flag int")
    filtered = retention.cohort_retention(trades, valid, 1).collect()
    assert [(str(r[0]), r[1], r[2]) for r in filtered] == [("2023-12-01", 0, 1), ("2024-01-01", 0, 1)]


def test_value_segments_balance(spark):
    n = 10
    mart = spark.createDataFrame(
        [(i, "direct", i % 2, 0, 1) for i in range(n)],
        "user_id long, acquisition_channel string, target_rate_user_flag int, rate_alert_user_flag int, "
        "onboarding_valid_flag int",
    )
    trades = tx(spark, [(i, "2024-01-01T00:00:00", {"amount": 50.0}) for i in range(n)])
    got = [tuple(r)[:2] for r in value.value_segments(mart, trades, ranges=3).collect()]
    assert got == [("Q1 lowest volume", 3), ("Q2", 3), ("Q3", 2), ("Q4 highest volume", 2)]


def test_checked_join_fails_on_duplicates(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, l string")
    good = spark.createDataFrame([(1, "x")], "k int, r string")
    bad = spark.createDataFrame([(1, "x"), (1, "y")], "k int, r string")
    assert rows(joins.checked_join(left, good, ["k"], "one_to_one")) == [(1, "a", "x"), (2, "b", None)]
    assert joins.checked_join(left, bad, ["k"], "one_to_many").count() == 3
    with pytest.raises(Exception, match="not unique"):
        joins.checked_join(left, bad, ["k"], "many_to_one").collect()
    with pytest.raises(Exception, match="not unique"):
        joins.checked_join(bad, left, ["k"], "one_to_one").collect()


def test_salted_join_equals_plain_join(spark):
    facts = spark.createDataFrame([(i % 3 if i % 2 else 0, i) for i in range(200)], "k int, v int")
    dim = spark.createDataFrame([(0, "a"), (1, "b"), (7, "c")], "k int, d string")
    for how in ("inner", "left"):
        assert rows(joins.salted_join(facts, dim, "k", how, salts=5)) == rows(facts.join(dim, "k", how))
    with pytest.raises(ValueError):
        joins.salted_join(facts, dim, "k", "full")


def test_orphans(spark):
    child = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    parent = spark.createDataFrame([(1,), (1,)], "k int")
    assert rows(joins.orphans(child, parent, "k")) == [(2, 2), (None, 1)]

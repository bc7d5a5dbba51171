"""The mart by increments against a full rebuild."""

from __future__ import annotations

import random

from helpers import events, rows, tx, users
from pyspark.sql import functions as F

from tidemark.operators import lifecycle
from tidemark.plans import increments


def trades(spark, seed=1, n=300):
    draw = random.Random(seed)
    made = []
    for _ in range(n):
        at = None if draw.random() < 0.02 else f"2024-01-{draw.randrange(1, 13):02d}T{draw.randrange(24):02d}:00:00"
        over = {"amount": draw.choice([0.1, 0.2, 7e8 / 3, None]), "status": draw.choice(["completed", "completed", "failed"]),
                "order": draw.choice(["manual", "target_rate"])}
        made.append((draw.choice([1, 1, 1, 2, 3, 4, 5, None]), at, over))
    return tx(spark, made)


def day(df, low, high):
    return df.where(F.dayofmonth("transaction_timestamp").between(low, high))


def test_three_increments_equal_a_rebuild(spark, tmp_path):
    df, store = trades(spark), f"{tmp_path}/store"
    present = df.where("transaction_timestamp IS NOT NULL")
    for low, high in ((1, 4), (5, 9), (10, 12)):
        increments.add_days(store, day(df, low, high))
        want = lifecycle.success_summary(day(df, 1, high))
        assert rows(increments.success_summary(spark, store).select(*want.columns)) == rows(want)
    increments.add_days(f"{store}-w", day(df, 1, 7), "week")
    increments.add_days(f"{store}-w", day(df, 8, 14), "week")
    assert rows(increments.success_summary(spark, f"{store}-w").select(*want.columns)) == rows(want)
    people = users(spark, [(i, "2024-01-01T00:00:00", "ad", "2024-01-02T00:00:00", None) for i in range(1, 8)])
    shown = events(spark, [(1, 2, "s", "2024-01-01T00:00:00", "rate_alert_created")])
    assert rows(increments.user_lifecycle(store, people, shown)) == rows(lifecycle.user_lifecycle(people, present, shown))


def test_days_come_again_and_late(spark, tmp_path):
    """A day that is run twice counts once, a corrected old day changes what came after, an increment may be empty."""
    df, other, store = trades(spark), trades(spark, seed=9), f"{tmp_path}/store"
    increments.add_days(store, df.limit(0))
    assert increments.success_summary(spark, store).count() == 0
    for low, high in ((1, 4), (9, 12), (9, 12), (5, 8)):
        increments.add_days(store, day(df, low, high))
    increments.add_days(store, day(other, 3, 3))
    increments.add_days(store, df.limit(0))
    whole = day(df, 1, 2).union(day(other, 3, 3)).union(day(df, 4, 12))
    want = lifecycle.success_summary(whole)
    assert rows(increments.success_summary(spark, store).select(*want.columns)) == rows(want)


def test_old_days_are_not_read(spark, tmp_path, monkeypatch):
    """An increment at the end merges its own days with the newest totals; one that corrects a day reads the days after the totals before it."""
    df, store = trades(spark), f"{tmp_path}/store"
    increments.add_days(store, day(df, 1, 10))
    increments.add_days(store, day(df, 11, 12))
    assert increments._versions(spark, store) == ["2024-01-10", "2024-01-12"]
    asked = []
    real = increments.stored_days
    monkeypatch.setattr(increments, "stored_days", lambda spark, store, days: asked.append(days) or real(spark, store, days))
    # Folders of old days can go without the next increment noticing.
    for old in range(1, 11):
        increments._drop(spark, f"{store}/days/day=2024-01-{old:02d}")
    late = tx(spark, [(77, "2024-01-13T10:00:00", {"amount": 5.0})])
    increments.add_days(store, late)
    want = lifecycle.success_summary(day(df, 1, 12).union(late))
    assert rows(increments.success_summary(spark, store).select(*want.columns)) == rows(want)
    assert asked == []
    increments.add_days(store, tx(spark, [(78, "2024-01-12T10:00:00", {"amount": 5.0})]))
    assert asked == [["2024-01-11", "2024-01-13"]]

"""As-of and interval joins, sessions and trailing sums against plain Python."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from helpers import events, rows
from pyspark.sql import functions as F

from tidemark.operators import joins, timeline

START = datetime(2024, 1, 1)
FACTS = "k long, at timestamp_ntz, x long"
STATES = "k long, since timestamp_ntz, v double, w string"


def made(seed: int, n: int, keys=(1, 1, 1, 1, 2, 3, None), span: int = 500) -> list[tuple]:
    """Rows of (key, instant, number): one key has most of them, instants repeat, some are null."""
    draw = random.Random(seed)
    return [
        (draw.choice(keys), START + timedelta(minutes=draw.randrange(span)) if draw.random() < 0.95 else None, draw.randrange(50)) for _ in range(n)
    ]


def plain_asof(facts, states, tolerance, strict):
    out = []
    for k, at, x in facts:
        found = [
            (since, v, w) for key, since, v, w in states
            if None not in (k, at, key, since) and key == k and (since < at if strict else since <= at)
        ]
        best = max(found, key=lambda s: (s[0], s[1], s[2]), default=(None, None, None))
        if best[0] is not None and tolerance is not None and at - best[0] > tolerance:
            best = (None, None, None)
        out.append((k, at, x, *best))
    return sorted(out, key=repr)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("tolerance", [None, timedelta(minutes=7)])
def test_asof_join(spark, strict, tolerance):
    facts = made(1, 400) + [(1, START + timedelta(minutes=9), 1)] * 60
    states = [(k, at, float(x), str(x)) for k, at, x in made(2, 120, keys=(1, 1, 1, 3, 4, None))]
    left, right = spark.createDataFrame(facts, FACTS), spark.createDataFrame(states, STATES)
    for ranges in (1, 9):
        got = timeline.asof_join(left, right, ["k"], "at", "since", ["v", "w"], tolerance, strict, ranges=ranges)
        assert got.columns == ["k", "at", "x", "matched_at", "v", "w"]
        assert rows(got) == plain_asof(facts, states, tolerance, strict)
    inner = timeline.asof_join(left, right, ["k"], "at", "since", ["v"], tolerance, strict, how="inner", ranges=4)
    assert inner.count() == sum(r[3] is not None for r in plain_asof(facts, states, tolerance, strict))


def test_asof_join_edges(spark):
    left, right = spark.createDataFrame(made(3, 30), FACTS), spark.createDataFrame([], STATES)
    assert all(r["v"] is None for r in timeline.asof_join(left, right, ["k"], "at", "since", ["v"]).collect())
    assert timeline.asof_join(left.limit(0), right, ["k"], "at", "since", ["v"]).count() == 0
    with pytest.raises(ValueError):
        timeline.asof_join(left, right.withColumnRenamed("v", "x"), ["k"], "at", "since", ["x"])
    with pytest.raises(ValueError):
        timeline.asof_join(left, right, ["k"], "at", "since", ["v"], how="full")


def test_asof_hot_key_takes_many_ranges(spark, monkeypatch):
    """No range holds more than its share of a key that has all rows."""
    seen = []
    real = timeline.spread
    monkeypatch.setattr(timeline, "spread", lambda *a, **k: seen.append(real(*a, **k)) or seen[-1])
    facts = spark.range(4000).select(F.lit(1).cast("long").alias("k"), F.lit(START).cast("timestamp_ntz").alias("at"), F.col("id").alias("x"))
    states = spark.createDataFrame([(1, START, 1.0, "a")], STATES)
    got = timeline.asof_join(facts, states, ["k"], "at", "since", ["v"], ranges=8)
    assert got.where("v = 1.0").count() == 4000
    assert max(r["count"] for r in seen[0].groupBy("_range").count().collect()) < 1500


def plain_pairs(points, spans, closed):
    out = []
    for k, at, x in points:
        for key, start, end, name in spans:
            if k is None or at is None or key != k:
                continue
            after = start is None or start < at or (closed in ("left", "both") and start == at)
            until = end is None or at < end or (closed in ("right", "both") and end == at)
            if after and until:
                out.append((k, at, x, start, end, name))
    return sorted(out, key=repr)


def spans_of(seed: int, n: int) -> list[tuple]:
    draw = random.Random(seed)
    out = []
    for i in range(n):
        start = START + timedelta(minutes=draw.randrange(-50, 500))
        length = draw.choice([0, 0, 1, 2, 30, 400, 100_000, -3])
        out.append((draw.choice([1, 1, 2, 5, None]), start, start + timedelta(minutes=length), f"s{i % 7}"))
    return out + [(1, None, START + timedelta(minutes=40), "ever"), (2, START + timedelta(minutes=90), None, "on"), (1, None, None, "all")] * 2


@pytest.mark.parametrize("closed", ["left", "right", "both", "neither"])
def test_interval_join(spark, closed):
    points, spans = made(5, 300) + [(1, START + timedelta(minutes=30), 7)] * 40, spans_of(6, 60)
    left = spark.createDataFrame(points, FACTS)
    right = spark.createDataFrame(spans, "k long, since timestamp_ntz, until timestamp_ntz, name string")
    want = plain_pairs(points, spans, closed)
    for split in (timeline.SPLIT_ROWS, 3):
        assert rows(timeline.interval_join(left, right, ["k"], "at", "since", "until", closed, split)) == want


def test_interval_join_over_numbers_and_edges(spark):
    points = spark.createDataFrame([(1, -2.5), (1, 0.0), (1, 7.25), (1, None)], "k int, p double")
    spans = spark.createDataFrame([(1, -3.0, -2.0, "a"), (1, 0.0, 0.0, "b"), (1, 7.0, 7.3, "c"), (2, 0.0, 9.0, "d")], "k int, lo double, hi double, name string")
    got = timeline.interval_join(points, spans, ["k"], "p", "lo", "hi", "both")
    assert rows(got.select("p", "name")) == [(-2.5, "a"), (0.0, "b"), (7.25, "c")]
    assert timeline.interval_join(points, spans.limit(0), ["k"], "p", "lo", "hi").collect() == []
    assert timeline.interval_join(points.limit(0), spans, ["k"], "p", "lo", "hi").collect() == []
    with pytest.raises(ValueError):
        timeline.interval_join(points, spans.withColumn("p", F.lit(1)), ["k"], "p", "lo", "hi")
    with pytest.raises(ValueError):
        timeline.interval_join(points, spans, ["k"], "p", "lo", "hi", "open")


def test_window_joins_take_several_anchors(spark):
    facts = spark.createDataFrame([(1, START + timedelta(days=d), d) for d in range(10)], FACTS)
    anchors = spark.createDataFrame([(1, START), (1, START + timedelta(days=3)), (1, None)], "k long, start timestamp_ntz")
    days = lambda n: F.make_dt_interval(F.lit(n))
    inside = joins.within_join(facts, anchors, "k", "at", "start", days(0), days(4))
    assert rows(inside.select("x", "start")) == sorted(
        [(d, START) for d in (1, 2, 3, 4)] + [(d, START + timedelta(days=3)) for d in (4, 5, 6, 7)], key=repr
    )
    early = joins.order_violation_join(facts, anchors, "k", "at", "start")
    assert sorted(r["x"] for r in early.collect()) == [0, 1, 2]


def plain_sessions(found, gap):
    by_user: dict = {}
    for user, at in found:
        if user is not None and at is not None:
            by_user.setdefault(user, []).append(at)
    out = []
    for user, instants in by_user.items():
        instants.sort()
        number, start, last, n = 0, None, None, 0
        for at in [*instants, None]:
            if last is not None and (at is None or at - last > gap):
                number += 1
                out.append((user, number, start, last, n))
                start, n = None, 0
            start, last, n = start or at, at, n + 1
    return sorted(out, key=repr)


def test_sessions(spark):
    draw = random.Random(7)
    found = [(draw.choice([1, 1, 1, 2, None]), START + timedelta(minutes=10 * draw.randrange(900)) if draw.random() < 0.97 else None) for _ in range(500)]
    found += [(3, START + timedelta(days=1, minutes=m)) for m in (-50, -20, 0, 0, 30, 60, 61)] + [(4, START)] * 30
    df = events(spark, [(i, u, "s", at and at.isoformat(), "view") for i, (u, at) in enumerate(found)])
    for gap in (timedelta(minutes=30), timedelta(hours=3), timedelta(days=2)):
        got = timeline.sessions(df, gap).select("user_id", "session_number", "session_start", "session_end", "events")
        assert rows(got) == plain_sessions(found, gap)
    assert timeline.sessions(df.limit(0), gap).collect() == []


def test_trailing_sums(spark):
    facts = made(9, 300, span=60 * 24 * 9) + [(1, START + timedelta(hours=5), 4)] * 30 + [(1, START + timedelta(hours=5), None)]
    df = spark.createDataFrame(facts, FACTS)
    frame = timedelta(days=2)
    want = []
    for k, at, x in facts:
        if k is None or at is None:
            want.append((k, at, x, None, None))
            continue
        inside = [v for key, t, v in facts if key == k and t is not None and at - frame <= t <= at]
        want.append((k, at, x, float(sum(v or 0 for v in inside)), sum(v is not None for v in inside)))
    for ranges in (1, 6):
        got = timeline.trailing_sums(df, ["k"], "at", "x", frame, ranges=ranges)
        assert rows(got.select("k", "at", "x", "trailing_sum", "trailing_count")) == sorted(want, key=repr)

"""Streams against their batch forms, over shuffled files, restarts and expiring state."""

from __future__ import annotations

import random
from datetime import timedelta

import pytest
from helpers import EVENTS, TX, USERS, events, rows, tx, users

from tidemark.operators.lifecycle import user_lifecycle
from tidemark.operators.timeline import sessions
from tidemark.streaming import milestones


def tables(spark):
    draw = random.Random(11)
    at = lambda: f"2024-0{draw.randrange(1, 7)}-{draw.randrange(10, 28)}T{draw.randrange(10, 23)}:00:0{draw.randrange(10)}.25"
    people = [(i, at(), draw.choice(["direct", "ad", None]), draw.choice([at(), None]), draw.choice([at(), None])) for i in range(25)]
    trades = [
        (draw.choice([1, 1, 1, *range(30), None]), at(),
         {"amount": draw.choice([0.1, 0.2, 1e9 / 3, 5.0]), "status": draw.choice(["completed", "completed", "failed"]),
          "order": draw.choice(["manual", "target_rate"]), "type": draw.choice(["exchange", "exchange", "deposit"])})
        for _ in range(200)
    ]
    shown = [(i, draw.randrange(30), "s", at(), draw.choice(["view", "rate_alert_created"])) for i in range(60)]
    return users(spark, people), tx(spark, trades), events(spark, shown)


def opened(spark, folder):
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/{name}")
    return read("users", USERS), read("tx", TX), read("events", EVENTS)


@pytest.mark.parametrize("idle", [None, timedelta(days=90), timedelta(milliseconds=1)])
def test_streamed_lifecycle_equals_the_mart(spark, tmp_path, idle):
    """Also when it is stopped and started again in between, and when states are forgotten at once."""
    frames = tables(spark)
    want = rows(user_lifecycle(*frames))
    halves = [df.randomSplit([0.5, 0.5], 3) for df in frames]
    for part in (0, 1):
        for name, half in zip(("users", "tx", "events"), halves):
            half[part].repartition(3).write.mode("append").parquet(f"{tmp_path}/{name}")
        stream = milestones.milestone_stream(*opened(spark, tmp_path), idle=idle)
        assert milestones.start(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination(240)
    got = milestones.merged(spark, f"{tmp_path}/out")
    assert rows(got) == want
    generations = spark.read.parquet(f"{tmp_path}/out").select("user_id", "generation").distinct().count()
    seen = len({r["user_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()})
    assert generations > seen if idle == timedelta(milliseconds=1) else generations == seen


def test_session_stream_equals_the_batch(spark, tmp_path):
    draw = random.Random(2)
    minutes = sorted(draw.randrange(0, 6000, 10) for _ in range(150))
    shown = [(i, draw.choice([1, 1, 2]), "s", f"2024-01-{1 + m // 1440:02d}T{m % 1440 // 60:02d}:{m % 60:02d}:00", "view") for i, m in enumerate(minutes)]
    later = [(900, 99, "s", "2024-03-01T00:00:00", "view"), (901, 99, "s", "2024-05-01T00:00:00", "view")]
    df = events(spark, shown)
    # Rows out of order inside a file; files in order of time, the last only moves the watermark.
    for n in range(5):
        df.where(f"event_id % 150 >= {30 * n} AND event_id < {30 * n + 30}").orderBy("event_name", "user_id").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for row in later:
        events(spark, [row]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = milestones.session_stream(stream, "30 minutes", "2 hours")
    query = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out")
    assert query.awaitTermination(240)
    got = spark.read.parquet(f"{tmp_path}/out").where("user_id < 99").selectExpr(
        "user_id", "CAST(session_start AS timestamp_ntz) AS session_start", "CAST(session_end AS timestamp_ntz) AS session_end", "events"
    )
    assert rows(got) == rows(sessions(df, timedelta(minutes=30)).select("user_id", "session_start", "session_end", "events"))


def test_streamed_state_is_merged_by_spark(spark, tmp_path):
    """A user's state takes no Python call of its own, and sums have all digits of the money type."""
    people = [(i, "2024-01-01T00:00:00", "direct", None, None) for i in range(5)]
    trades = [(i % 5, "2024-01-02T00:00:00", {"amount": 4e17 / 3}) for i in range(40)]
    frames = users(spark, people), tx(spark, trades), events(spark, [(1, 1, "s", "2024-01-01T00:00:00", "view")])
    for name, df in zip(("users", "tx", "events"), frames):
        df.repartition(4).write.parquet(f"{tmp_path}/{name}")
    stream = milestones.milestone_stream(*opened(spark, tmp_path))
    query = milestones.start(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert query.awaitTermination(240)
    operators = {o["operatorName"] for p in query.recentProgress for o in p["stateOperators"]}
    assert operators == {"stateStoreSave"}
    assert rows(milestones.merged(spark, f"{tmp_path}/out")) == rows(user_lifecycle(*frames))

"""Sketches against exact answers, within their stated bounds."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import sketches


@pytest.fixture(scope="module")
def facts(spark):
    """A hot channel with nine tenths of the rows, a null one, null users and values."""
    n = F.col("id")
    return spark.range(200_000).select(
        F.when(n % 10 > 0, "hot").when(n % 20 == 0, "small").alias("channel"),
        (n % 30).cast("int").alias("day"),
        F.when(n % 97 > 0, F.pmod(F.xxhash64("id"), F.lit(30_000))).alias("user_id"),
        F.when(n % 89 > 0, F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(10_000)).cast("double")).alias("amount"),
    )


@pytest.fixture(scope="module")
def merged(facts):
    daily = sketches.sketch_states(facts, ["channel", "day"], value="amount")
    return sketches.merged_states(daily, ["channel"]).cache()


def test_distinct_users(facts, merged):
    exact = {r["channel"]: (r["u"], r["n"]) for r in facts.groupBy("channel").agg(F.count_distinct("user_id").alias("u"), F.count(F.lit(1)).alias("n")).collect()}
    got = merged.select("channel", "rows", sketches.users_estimate().alias("h"), sketches.users_estimate("users_theta").alias("t")).collect()
    assert len(got) == len(exact) == 3
    for r in got:
        users, n = exact[r["channel"]]
        assert r["rows"] == n
        assert abs(r["h"] - users) <= sketches.HLL_ERROR * users
        assert abs(r["t"] - users) <= sketches.THETA_ERROR * users


def test_quantiles(facts, merged):
    for p in (0.01, 0.5, 0.99):
        cut = merged.select(F.col("channel").alias("c"), sketches.quantile(p).alias("q"))
        ranked = facts.where("amount IS NOT NULL").join(cut, F.col("channel").eqNullSafe(F.col("c")))
        shares = ranked.groupBy("c").agg(F.avg((F.col("amount") < F.col("q")).cast("int")).alias("below"), F.avg((F.col("amount") <= F.col("q")).cast("int")).alias("upto"))
        for r in shares.collect():
            assert r["below"] - sketches.RANK_ERROR <= p <= r["upto"] + sketches.RANK_ERROR


def test_shared_users(facts):
    weeks = facts.withColumn("week", (F.col("day") / 7).cast("int"))
    states = sketches.merged_states(sketches.sketch_states(weeks, ["channel", "day", "week"], value="amount"), ["channel", "week"])
    users = lambda w: weeks.where((F.col("week") == w) & (F.col("channel") == "hot")).select("user_id").dropna().distinct()
    exact = users(0).intersect(users(1)).count()
    row = sketches.shared_users(states, ["channel"], "week", 0, 1).where("channel = 'hot'").head()
    assert abs(row["shared"] - exact) <= sketches.THETA_ERROR * users(0).union(users(1)).distinct().count()
    assert sketches.shared_users(states, ["channel"], "week", 0, 77).count() == 0


def test_sizes_and_empty(facts, merged):
    sizes = sketches.state_bytes(merged)
    assert sizes["users_hll"] <= sketches.HLL_BYTES and sizes["users_theta"] <= sketches.THETA_BYTES and sizes["value_kll"] <= sketches.KLL_BYTES
    assert sketches.state_bytes(merged.limit(0)) == {"users_hll": 0, "users_theta": 0, "value_kll": 0}
    none = sketches.sketch_states(facts.where("user_id IS NULL AND amount IS NULL"), ["channel"], value="amount")
    for r in none.select(sketches.users_estimate().alias("u"), sketches.quantile(0.5).alias("q")).collect():
        assert (r["u"], r["q"]) == (0, None)


def test_merging_order_changes_nothing(facts):
    daily = sketches.sketch_states(facts, ["channel", "day"], value="amount")
    by_half = sketches.merged_states(daily.withColumn("half", F.col("day") % 2), ["channel", "half"])
    estimate = lambda df: sorted((r["channel"] or "", r["t"]) for r in df.select("channel", sketches.users_estimate("users_theta").alias("t")).collect())
    assert estimate(sketches.merged_states(by_half, ["channel"])) == estimate(sketches.merged_states(daily, ["channel"]))

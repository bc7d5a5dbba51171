from __future__ import annotations

import random

import numpy as np
import pytest
from helpers import plan, rows
from pyspark.sql import functions as F

from tidemark.operators import ranking


def frame(spark, values, parts=5):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double").repartition(parts)


def series(kind: str, n: int) -> list:
    rng = random.Random(7)
    if kind == "spread":
        return [rng.uniform(0, 1000) for _ in range(n)]
    if kind == "ties":
        return [1.0] * n
    if kind == "hot":
        return [5.0 if i % 3 == 0 else rng.uniform(0, 10) for i in range(n)]
    return [None if i % 4 == 0 else float(rng.randint(0, 5)) for i in range(n)]


@pytest.mark.parametrize("kind", ["spread", "ties", "hot", "nulls"])
@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_rank_and_tiles_match_sql_window(spark, kind, ranges):
    df = frame(spark, series(kind, 501))
    df.createOrReplaceTempView("ranked_input")
    want = spark.sql(
        "SELECT id, row_number() OVER (ORDER BY v, id) AS r, ntile(4) OVER (ORDER BY v, id) AS t FROM ranked_input"
    )
    rank = ranking.global_rank(df, "v", "id", "r", ranges=ranges).select("id", "r")
    tile = ranking.ntile_scalable(df, "v", "id", 4, "t", ranges=ranges).select("id", "t")
    assert rows(rank.join(tile, "id")) == rows(want)


@pytest.mark.parametrize("n", [1, 3, 4, 6])
def test_few_rows(spark, n):
    df = frame(spark, [float(i) for i in range(n)])
    got = sorted(r["t"] for r in ranking.ntile_scalable(df, "v", "id", 4, "t").collect())
    assert got == expected(n)


def expected(n, k=4):
    size, extra = divmod(n, k)
    return [t for t in range(1, k + 1) for _ in range(size + (1 if t <= extra else 0))]


def test_hot_value_is_split(spark):
    """A value held by all rows still spreads over many ranges through the tie column."""
    sizes = ranking.spread(frame(spark, [1.0] * 3200), "v", "id", ranges=64).groupBy("_range").count()
    biggest = sizes.agg(F.max("count")).head()[0]
    assert biggest <= 3200 / 16


def test_no_single_task_over_rows(spark):
    df = frame(spark, series("spread", 300))
    text = plan(ranking.ntile_scalable(df, "v", "id", 4, "t", ranges=4))
    for part in text.split("Exchange SinglePartition")[1:]:
        # Below a single-partition exchange there are only the per-range totals.
        assert "HashAggregate" in part.split("\n")[1]


def test_running_totals_descending(spark):
    df = spark.createDataFrame([(3.0, 1), (2.0, 5), (1.0, 2)], "v double, n int")
    got = ranking.running_totals(df, "v", {"upto": F.col("n")}, descending=True, ranges=2, grand={"all": "upto"})
    assert rows(got.select("v", "upto", "all")) == [(1.0, 8, 8), (2.0, 6, 8), (3.0, 1, 8)]


@pytest.mark.parametrize("kind", ["spread", "ties", "hot", "nulls"])
def test_exact_quantiles(spark, kind):
    values = series(kind, 997)
    known = np.array([v for v in values if v is not None])
    ps = [0.0, 0.01, 0.25, 0.33, 0.5, 0.75, 1.0]
    want = list(np.quantile(known, ps))
    assert ranking.exact_quantiles(frame(spark, values), "v", ps) == pytest.approx(want, abs=1e-12)
    assert ranking.exact_quantiles(frame(spark, values), "v", ps, ranges=23) == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("kind", ["long", "decimal", "text"])
def test_rank_compares_in_the_columns_own_type(spark, kind):
    """Values that are equal as doubles, and texts, are ordered as SQL orders them."""
    made = {"long": "1152921504606846976 + id % 50", "decimal": "cast(12e18 as decimal(38,8)) + id % 50 / 1e6", "text": "hex(id % 50)"}
    df = spark.range(2000).selectExpr("id", f"{made[kind]} AS v").repartition(5, "id")
    df = df.withColumn("v", F.col("v").cast("decimal(38,8)")) if kind == "decimal" else df
    df.createOrReplaceTempView("typed_input")
    want = spark.sql("SELECT id, row_number() OVER (ORDER BY v, id) AS r FROM typed_input")
    assert rows(ranking.global_rank(df, "v", "id", "r", ranges=8).select("id", "r")) == rows(want)


def test_hot_value_takes_more_ranges_when_more_are_asked(spark):
    values = [5.0 if i % 3 == 0 else float(i) for i in range(6000)]
    sizes = []
    for ranges in (12, 48):
        counted = ranking.spread(frame(spark, values), "v", "id", ranges=ranges).groupBy("_range").count()
        sizes.append(counted.agg(F.max("count")).head()[0])
    assert sizes[1] < sizes[0] / 2


def test_quantiles_of_nothing(spark):
    assert ranking.exact_quantiles(frame(spark, [None, None]), "v", [0.5]) == [None]


def test_approx_quantile_is_near(spark):
    got = ranking.approx_quantiles(frame(spark, [float(i) for i in range(1001)]), "v", [0.5])[0]
    assert abs(got - 500) <= 2


def test_best_rows(spark):
    df = spark.createDataFrame([("a", 1, 9.0), ("a", 2, 9.0), ("b", 3, 1.0)], "g string, id int, v double")
    assert rows(ranking.best_per(df, ["g"], F.desc("v"), "id").select("g", "id")) == [("a", 1), ("b", 3)]
    assert ranking.best(df, F.desc("v"), F.desc("id")).head()["id"] == 2

from __future__ import annotations

import math

import pytest
from helpers import ts
from pyspark.sql import functions as F

from tidemark.functions import labels, numeric, temporal
from tidemark.functions.stats import two_sided_p


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("_")).select(
        column.alias("out")
    ).head()["out"]


@pytest.mark.parametrize(
    "value,digits,want", [(2.5, 0, 3.0), (-2.5, 0, -3.0), (1.005, 2, 1.0), (0.125, 2, 0.13), (1e17, 2, 1e17), (None, 2, None)]
)
def test_round_half_up(spark, value, digits, want):
    assert one(spark, numeric.round_half_up(F.lit(value).cast("double"), digits)) == want


def test_rates_on_zero(spark):
    assert one(spark, numeric.pct(F.lit(1), F.lit(0))) is None
    assert one(spark, numeric.pct(F.lit(1), F.lit(3))) == 33.33


def test_exact_sum_does_not_depend_on_order(spark):
    values = [0.1, 1e9, 0.2, 1e-3, 0.3] * 2000
    a = spark.createDataFrame([(v,) for v in values], "x double")
    b = spark.createDataFrame([(v,) for v in sorted(values)], "x double").repartition(7)
    total = [df.agg(numeric.exact_sum("x").alias("s")).head()["s"] for df in (a, b)]
    assert total[0] == total[1]


def test_empty_aggregates(spark):
    empty = spark.createDataFrame([], "x double")
    got = empty.agg(numeric.count_where(F.col("x") > 0).alias("a"), numeric.exact_sum("x").alias("b")).head()
    assert got["a"] is None and got["b"] is None


def test_clip_keeps_null(spark):
    assert one(spark, numeric.clip(F.lit(None).cast("double"), 0.0, 1.0)) is None
    assert one(spark, numeric.clip(F.lit(7.0), 0.0, 1.0)) == 1.0


def test_elapsed_and_windows(spark):
    df = spark.createDataFrame(
        [(ts("2024-01-01T00:00:00"), ts("2024-01-15T00:00:00.500000"))], "a timestamp_ntz, b timestamp_ntz"
    )
    got = df.select(
        temporal.elapsed("a", "b").alias("d"),
        temporal.elapsed("a", "b", "hour").alias("h"),
        temporal.within_days("a", "b", 14).alias("in_time"),
        temporal.whole_second("b").alias("whole"),
    ).head()
    assert math.isclose(got["d"], 14 + 0.5 / 86400)
    assert math.isclose(got["h"], 14 * 24 + 0.5 / 3600)
    assert got["in_time"] is True
    assert got["whole"] == ts("2024-01-15T00:00:00")


def test_elapsed_ignores_session_zone(spark):
    df = spark.createDataFrame(
        [(ts("2024-03-09T12:00:00"), ts("2024-03-10T12:00:00"))], "a timestamp_ntz, b timestamp_ntz"
    )
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = df.select(temporal.elapsed("a", "b").alias("d"), temporal.whole_second("a").alias("w")).head()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got["d"] == 1.0 and got["w"] == ts("2024-03-09T12:00:00")


def test_months(spark):
    df = spark.createDataFrame([(ts("2023-12-31T23:59:59"), ts("2024-02-01T00:00:00"))], "a timestamp_ntz, b timestamp_ntz")
    got = df.select(temporal.months_between_starts("a", "b").alias("m"), temporal.month_key("b").alias("k")).head()
    assert (got["m"], got["k"]) == (2, "2024-02")


def test_unparseable(spark):
    df = spark.createDataFrame([("2024-01-01 10:00:00",), ("nope",), (None,), ("2024-02-30",)], "s string")
    assert [r[0] for r in df.select(temporal.unparseable("s")).collect()] == [False, True, False, True]


def test_bins_at_their_edges(spark):
    df = spark.createDataFrame([(0.35,), (0.70,), (None,), (1.5,)], "p double")
    right = labels.bin_right("p", [-0.01, 0.35, 0.70, 1.00], ["L", "M", "H"])
    left = labels.bin_left("p", [0.35, 0.70], ["L", "M", "H"])
    got = [tuple(r) for r in df.select(right, left).collect()]
    assert got == [("L", "M"), ("M", "H"), (None, "H"), (None, "H")]


def test_first_match_null_falls_through(spark):
    df = spark.createDataFrame([(None,), (1,), (5,)], "x int")
    got = df.select(labels.first_match([("x > 3", "big"), ("x > 0", "small")], "none")).collect()
    assert [r[0] for r in got] == ["none", "small", "big"]


def test_maps_and_labels(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    assert [r[0] for r in df.select(labels.map_with_default("c", {"a": 1}, 0)).collect()] == [1, 0, 0]
    assert [r[0] for r in df.select(labels.recode("c", {"a": 1})).collect()] == [1, None, None]
    assert [r[0] for r in df.select(labels.not_in_domain("c", ["a"])).collect()] == [False, True, True]
    assert one(spark, labels.clean_label(F.lit("paid_SOCIAL"))) == "Paid social"


def test_two_sided_p(spark):
    df = spark.createDataFrame([(1.959963984540054,), (0.0,), (None,)], "z double")
    got = [r[0] for r in df.select(two_sided_p("z")).collect()]
    assert math.isclose(got[0], 0.05, rel_tol=1e-9) and got[1] == 1.0 and got[2] is None

"""Grouping sets, reconciled extracts and ordered steps against plain Python."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from helpers import plan, rows
from pyspark.sql import functions as F

from tidemark.operators import cubes, reconcile, steps

START = datetime(2024, 1, 1)
FLAT = "user_id long, a string, b int, v double"


def flat(seed: int, n: int) -> list[tuple]:
    draw = random.Random(seed)
    return [(draw.choice([1, 1, 1, 2, 3, None]), draw.choice(["x", "y", None]), draw.choice([1, 2, None]), draw.choice([1.25, 2.0, None])) for _ in range(n)]


def plain_sets(data, sets):
    out = []
    for s in sets:
        cells: dict = {}
        for u, a, b, v in data:
            users, n, total = cells.get(k := (a if "a" in s else None, b if "b" in s else None), (set(), 0, None))
            cells[k] = (users | ({u} - {None}), n + 1, total if v is None else (total or 0) + v)
        name = ",".join(d for d in ("a", "b") if d in s) or "total"
        out += [(name, *k, len(users), n, total) for k, (users, n, total) in cells.items()]
    return sorted(out, key=repr)


@pytest.mark.parametrize("sets", [cubes.cube_sets(["a", "b"]), cubes.rollup_sets(["a", "b"]), [["b"]], [["a", "b"], ["b", "a"], ["a"]]])
def test_distinct_by_sets(spark, sets):
    data = flat(1, 300)
    got = cubes.distinct_by_sets(spark.createDataFrame(data, FLAT), sets, sums=["v"])
    dims = [c for c in got.columns if c in "ab"]
    got = got.select("set_name", *[F.col(d) if d in dims else F.lit(None).alias(d) for d in ("a", "b")], "users", "rows", "v")
    assert rows(got) == plain_sets(data, list({frozenset(s): s for s in sets}.values()))


def test_total_alone_and_edges(spark):
    df = spark.createDataFrame(flat(2, 40), FLAT)
    assert [tuple(r) for r in cubes.distinct_by_sets(df, [[]]).collect()] == [("total", 3, 40)]
    assert cubes.distinct_by_sets(df.limit(0), cubes.cube_sets(["a"])).count() == 0
    wide = df.withColumns({"rows": F.lit(1), "set_name": F.lit("s"), "__gid": F.lit(2)})
    assert rows(cubes.distinct_by_sets(wide, [["a"]])) == rows(cubes.distinct_by_sets(df, [["a"]]))
    with pytest.raises(ValueError):
        cubes.distinct_by_sets(wide, [["rows"]])


def test_sets_repeat_cells_not_rows(spark):
    """Below the expansion rows are already one per user and finest cell."""
    df = spark.range(20_000).select((F.col("id") % 3).alias("user_id"), F.lit("x").alias("a"), (F.col("id") % 2).cast("int").alias("b"))
    made = cubes.distinct_by_sets(df, cubes.cube_sets(["a", "b"]))
    text = plan(made)
    assert text.index("Expand") < text.index("Exchange", text.index("Expand")) < text.index("Range")
    assert "HashAggregate" in text[text.index("Expand") : text.index("Range")]
    made.collect()
    assert df.groupBy("user_id", "a", "b").count().count() * 4 == 24


ROW = "k long, s string, x double, l array<int>"


def extracts(seed: int, n: int):
    draw = random.Random(seed)

    def row():
        return draw.choice([1, 2, 3, 4, None]), draw.choice(["p", None, ""]), draw.choice([0.5, None, float("inf")]), draw.choice([[1], [], None, [None, 1], [1, None]])

    left = [row() for _ in range(n)]
    right = [r for r in left if draw.random() < 0.8] + [row() for _ in range(n // 5)]
    draw.shuffle(right)
    return left, right


def key(r):
    return repr(r)


def test_surplus(spark):
    left, right = extracts(3, 120)
    left += [(9, "hot", 1.0, [1])] * 500
    right += [(9, "hot", 1.0, [1])] * 490
    got = reconcile.surplus(spark.createDataFrame(left, ROW), spark.createDataFrame(right, ROW).select("l", "x", "k", "s"))
    a, b = Counter(map(key, left)), Counter(map(key, right))
    want = {(r, "left", n) for r, n in (a - b).items()} | {(r, "right", n) for r, n in (b - a).items()}
    assert {(repr(tuple(r)[:4]), r["surplus_side"], r["surplus_rows"]) for r in got.collect()} == want and len(want) > 10


def test_nulls_in_other_columns_differ(spark):
    left, right = spark.createDataFrame([(None, 1)], "a int, b int"), spark.createDataFrame([(1, None)], "a int, b int")
    assert reconcile.surplus(left, right).count() == 2
    assert reconcile.surplus(left, left).count() == 0


def test_key_changes(spark):
    left = [(1, "a", 1.0, None), (2, "a", 1.0, None), (3, "a", 1.0, None), (3, "a", 1.0, None), (None, "a", 1.0, []), (5, "a", 1.0, [1]), (6, "a", 1.0, None)]
    right = [(1, "a", 1.0, None), (2, None, 1.0, [None]), (3, "a", 1.0, None), (None, "a", 1.0, None), (5, "b", 1.0, [1]), (5, "c", 1.0, [1]), (7, "", None, None)]
    got = reconcile.key_changes(spark.createDataFrame(left, ROW), spark.createDataFrame(right, ROW), ["k"])
    assert rows(got) == sorted(
        [(2, "changed", 1, 1, "s,l"), (3, "removed", 1, 0, None), (None, "changed", 1, 1, "l"), (5, "changed", 1, 2, None), (6, "removed", 1, 0, None), (7, "added", 0, 1, None)],
        key=repr,
    )
    empty = spark.createDataFrame([], ROW)
    assert reconcile.key_changes(empty, empty, ["k"]).count() == 0
    assert rows(reconcile.change_summary(reconcile.key_changes(empty, spark.createDataFrame(left, ROW), ["k"]))) == [("added", 6, 0, 7)]


def test_surplus_refuses_what_it_cannot_compare(spark):
    df = spark.range(1)
    for other in (df.withColumn("b", F.lit(1)), df.select(F.col("id").cast("int"))):
        with pytest.raises(ValueError):
            reconcile.surplus(df, other)
    maps = df.select(F.create_map("id", "id").alias("m"))
    with pytest.raises(ValueError):
        reconcile.surplus(maps, maps)
    named = df.withColumn("surplus_rows", F.lit(1))
    with pytest.raises(ValueError):
        reconcile.surplus(named, named)


NAMES = ("p", "q", "r")


def plain_reached(data, names, within) -> dict:
    """By trying every start and going on with the earliest next step."""
    out: dict = {}
    for user in {u for u, at, n in data if u is not None and at is not None and n in names}:
        mine = sorted((at, n) for u, at, n in data if u == user and at is not None and n in names)
        best = 0
        for start, n in mine:
            if n != names[0]:
                continue
            now, done = start, 1
            for wanted in names[1:]:
                later = [at for at, m in mine if m == wanted and now < at <= start + within]
                if not later:
                    break
                now, done = min(later), done + 1
            best = max(best, done)
        out[user] = best
    return out


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp", "date"])
def test_ordered_steps(spark, seed, kind):
    draw = random.Random(seed)
    data = [
        (draw.choice([1, 1, 1, 1, *range(2, 30), None]), START + timedelta(days=draw.randrange(60)) if draw.random() < 0.95 else None, draw.choice([*NAMES, "other", None]))
        for _ in range(350)
    ]
    data += data[:40]
    df = spark.createDataFrame(data, "user_id long, event_timestamp timestamp_ntz, event_name string")
    df = df.withColumn("event_timestamp", F.col("event_timestamp").cast(kind))
    within = timedelta(days=9)
    got = steps.ordered_steps(df, NAMES, within)
    assert {r[0]: r[1] for r in got.collect()} == plain_reached(data, NAMES, within)


def test_hot_user_over_many_ranges(spark):
    """One user has nine rows in ten; the ranges split them, and the states join to the same answer."""
    draw = random.Random(7)
    names = ("p", "q", "r", "s")
    data = [(1 if draw.random() < 0.9 else 2, START + timedelta(minutes=draw.randrange(5000)), draw.choice(["p", "q", "q", "other"])) for _ in range(3000)]
    data += [(1, START + timedelta(minutes=4000), "r"), (1, START + timedelta(minutes=4990), "s"), (2, START + timedelta(minutes=9000), "r")]
    df = spark.createDataFrame(data, "user_id long, event_timestamp timestamp_ntz, event_name string")
    for minutes in (3, 400, 995, 10_000):
        within = timedelta(minutes=minutes)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = {r[0]: r[1] for r in steps.ordered_steps(df, names, within).collect()}
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert got == plain_reached(data, names, within)


def test_ordered_steps_edges(spark):
    empty = spark.createDataFrame([], "user_id long, event_timestamp timestamp_ntz, event_name string")
    assert steps.ordered_steps(empty, NAMES, timedelta(days=1)).count() == 0
    one = spark.createDataFrame([("u", START, "p"), ("u", START, "q"), ("v", START, "q")], "user_id string, event_timestamp timestamp_ntz, event_name string")
    wide = one.withColumns({"at": F.lit(1), "step": F.lit(2), "user": F.lit(3)})
    reached = steps.ordered_steps(wide, NAMES, timedelta(days=1))
    assert rows(reached) == [("u", 1), ("v", 0)]
    assert [tuple(r) for r in steps.ordered_funnel(reached, NAMES).orderBy("step_number").collect()] == [(1, "p", 1, 100.0), (2, "q", 0, 0.0), (3, "r", 0, None)]
    for bad in ((), ("p", "p")):
        with pytest.raises(ValueError):
            steps.ordered_steps(one, bad, timedelta(days=1))

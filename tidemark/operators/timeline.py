"""Joins and groups along time: the value in force, intervals that hold an instant, sessions, trailing sums.

None of them brings all rows of a key to one task: a key with most of the rows is split by time, and by row where many
rows share an instant.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.temporal import elapsed_seconds
from tidemark.operators.ranking import spread
from tidemark.plans.staging import staged

#: A time bin with more points than this is split.
SPLIT_ROWS = 200_000
#: At most so many bins are split, so that their list stays small enough to go to every task.
MOST_SPLIT = 100_000
#: Bins of one level are so many times as wide as those of the level below.
WIDER = 4


# As-of ------------------------------------------------------------------------------------------------------------


def asof_join(
    facts: DataFrame,
    states: DataFrame,
    keys: Sequence[str],
    at: str,
    state_at: str,
    values: Sequence[str],
    tolerance: timedelta | None = None,
    strict: bool = False,
    how: str = "left",
    matched_at: str = "matched_at",
    ranges: int | None = None,
) -> DataFrame:
    """Each fact with the values of its key's latest state at or before ``at`` (``strict``: before it).

    Both sides are laid in one order of (key, time) and dealt out in ranges of balanced size, so that a key with most
    of the rows takes most of the ranges.  Inside a range the last state is carried forward; a range's rows before its
    first state take the last state of the ranges before, of which there is one for each range.  Runs jobs at once.

    ``tolerance`` is the greatest age a state may have.  Facts without a match, a key or a time have nulls (``how="inner"``:
    they go).  States without a key or a time match nothing; of states that share key and instant the greatest
    values count.  Repeated facts stay repeated.
    """
    if how not in ("left", "inner"):
        raise ValueError("asof_join keeps the fact side: use left or inner")
    if set(values) & set(facts.columns) or matched_at in facts.columns:
        raise ValueError(f"facts already have a column of {[*values, matched_at]}")
    key = lambda: F.struct(*[F.col(k) for k in keys]).alias("key")
    present = states.dropna(subset=[*keys, state_at])
    latest = present.groupBy(*keys, state_at).agg(F.max(F.struct(*values)).alias("v"))
    state = F.struct(F.col(state_at).alias("at"), F.col("v"))
    right = latest.select(key(), F.col(state_at).alias("at"), F.lit(1 if strict else 0).alias("side"), F.lit(0).cast("long").alias("tie"), state.alias("state"))
    left = facts.select(
        key(), F.col(at).alias("at"), F.lit(0 if strict else 1).alias("side"), F.xxhash64(*facts.columns).alias("tie"),
        F.struct(*facts.columns).alias("fact"),
    )
    both = left.unionByName(right, allowMissingColumns=True)
    tagged = spread(both.withColumn("order", F.struct("key", "at", "side", "tie")), "order", ranges=ranges)
    inside = W.partitionBy("_range", "key").orderBy("at", "side").rowsBetween(W.unboundedPreceding, W.currentRow)
    held = F.when(F.col("state").isNotNull(), F.struct("key", "state"))
    # One row for each range.
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ends = tagged.groupBy("_range").agg(F.max(held).alias("held")).select("_range", F.max("held").over(before).alias("carried"))
    found = tagged.withColumn("own", F.last("state", ignorenulls=True).over(inside)).where("fact IS NOT NULL").join(ends, "_range")
    best = F.coalesce("own", F.when(F.col("carried.key") == F.col("key"), F.col("carried.state")))
    found = found.select("fact", "at", best.alias("best"))
    if tolerance is not None:
        found = found.withColumn("best", F.when(F.col("best.at") >= F.col("at") - F.lit(tolerance), F.col("best")))
    if how == "inner":
        found = found.where("best IS NOT NULL")
    return found.select("fact.*", F.col("best.at").alias(matched_at), *[F.col("best.v")[v].alias(v) for v in values])


# Intervals --------------------------------------------------------------------------------------------------------


def _axis(df: DataFrame, column: str) -> Column:
    """A whole number that never falls as the column rises: seconds of an instant, the floor of a number."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.DateType | T.TimestampNTZType):
        return F.floor(elapsed_seconds(F.lit("1970-01-01").cast("timestamp_ntz"), F.col(column).cast("timestamp_ntz")))
    if isinstance(kind, T.TimestampType):
        return F.unix_seconds(column)
    return F.floor(F.col(column)).cast("long")


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    at: str,
    start: str,
    end: str,
    closed: str = "left",
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """Every pair of a point and an interval of its key that holds it; intervals of a key may overlap.

    Time is cut into bins, on levels of growing width.  An interval goes to the level where it covers two or three bins,
    whatever its length, and a point to its bin on each level in use.  Bins are joined by equality and the bounds are then
    tested exactly, so bins never change the result.  Bins are counted first, and those with over ``split_rows`` points
    are split by a hash of the point, their intervals being repeated for each part.  Runs jobs at once.

    ``closed`` says which bounds belong to an interval: left, right, both or neither.  A null bound is open: an interval
    without start began ever.  Points without a key or an instant, intervals without a key and empty intervals match nothing.
    Repeated rows give repeated pairs.
    """
    if closed not in ("left", "right", "both", "neither"):
        raise ValueError("closed is left, right, both or neither")
    clash = (set(points.columns) & set(intervals.columns)) - set(keys)
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")
    lasting = F.greatest(F.col("_to") - F.col("_from"), F.lit(1)).cast("double")
    level = F.when(F.col("_from").isNull() | F.col("_to").isNull(), F.lit(-1)).otherwise(F.ceil(F.log(float(WIDER), lasting))).cast("int")
    wide = lambda x: F.pow(F.lit(float(WIDER)), x).cast("long")
    spans = intervals.dropna(subset=list(keys)).withColumns({"_from": _axis(intervals, start), "_to": _axis(intervals, end)})
    spans = spans.withColumn("_level", level).where("_from IS NULL OR _to IS NULL OR _from <= _to")
    bins = F.sequence(F.floor(F.col("_from") / wide(F.col("_level"))), F.floor(F.col("_to") / wide(F.col("_level"))))
    spans = spans.withColumn("_bin", F.explode(F.when(F.col("_level") < 0, F.array(F.lit(0).cast("long"))).otherwise(bins)))
    # As many as there are powers of WIDER up to the longest interval.
    levels = sorted(r[0] for r in spans.select("_level").distinct().collect())
    if not levels:
        return points.join(intervals, list(keys)).where(F.lit(False))
    seen = points.dropna(subset=[*keys, at]).withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels])))
    own = F.floor(_axis(points, at) / wide(F.col("_level")))
    seen = seen.withColumn("_bin", F.when(F.col("_level") < 0, F.lit(0).cast("long")).otherwise(own))
    by = [*keys, "_level", "_bin"]
    loads = staged(seen.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > split_rows), "interval-loads")
    most = max(split_rows, (loads.agg(F.sum("_n")).head()[0] or 0) // MOST_SPLIT)
    heavy = loads.where(F.col("_n") > most).select(*by, F.ceil(F.col("_n") / most).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    seen = seen.join(F.broadcast(heavy), by, "left").withColumn("_part", F.pmod(F.xxhash64(*points.columns), parts).cast("int"))
    spans = spans.join(F.broadcast(heavy), by, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    met = seen.select(*points.columns, "_level", "_bin", "_part").join(spans.drop("_parts", "_from", "_to"), [*by, "_part"])
    x, low, high = F.col(at), F.col(start), F.col(end)
    after = low <= x if closed in ("left", "both") else low < x
    until = x <= high if closed in ("right", "both") else x < high
    inside = (low.isNull() | after) & (high.isNull() | until)
    return met.where(inside).select(*points.columns, *[c for c in intervals.columns if c not in keys])


# Sessions ---------------------------------------------------------------------------------------------------------


def _numbered(df: DataFrame, part: Sequence[str], start: str, end: str, gap: timedelta, out: str) -> DataFrame:
    """A running number that grows where a row starts more than ``gap`` after the one before it ended."""
    order = W.partitionBy(*part).orderBy(start)
    opens = F.lag(end).over(order).isNull() | (F.col(start) > F.lag(end).over(order) + F.lit(gap))
    return df.withColumn("_opens", opens.cast("int")).withColumn(out, F.sum("_opens").over(order)).drop("_opens")


def sessions(events: DataFrame, gap: timedelta, user: str = "user_id", at: str = "event_timestamp") -> DataFrame:
    """(user, session_number, session_start, session_end, events): runs of a user's events at most ``gap`` apart.

    Rows of one instant are counted first.  Sessions are found inside each day, so a user with most of the events is spread
    over the calendar, and results of days that are at most ``gap`` apart across midnight are merged; a user
    has at most a day's length over ``gap`` of them in a day.  Events without a user or an instant are in no session.
    """
    instants = events.dropna(subset=[user, at]).groupBy(user, at).agg(F.count(F.lit(1)).alias("events"))
    daily = instants.withColumn("day", F.col(at).cast("date"))
    daily = _numbered(daily, [user, "day"], at, at, gap, "run")
    pieces = daily.groupBy(user, "day", "run").agg(
        F.min(at).alias("session_start"), F.max(at).alias("session_end"), F.sum("events").alias("events")
    )
    whole = _numbered(pieces, [user], "session_start", "session_end", gap, "session_number")
    return whole.groupBy(user, "session_number").agg(
        F.min("session_start").alias("session_start"), F.max("session_end").alias("session_end"), F.sum("events").alias("events")
    )


# Frames by value --------------------------------------------------------------------------------------------------


def trailing_sums(
    facts: DataFrame,
    keys: Sequence[str],
    at: str,
    amount: str,
    frame: timedelta,
    sum_out: str = "trailing_sum",
    count_out: str = "trailing_count",
    ranges: int | None = None,
) -> DataFrame:
    """Each fact with the sum and number of its key's amounts from ``frame`` before ``at`` up to it, both included.

    The sum up to an instant minus the sum before the frame.  Sums up to an instant are made from totals of days, so a hot
    key is split by day, and the sum before the frame is found by ``asof_join``.  Sums are fixed-point.  Runs jobs at once.

    Null amounts count 0 in the sum and aren't counted; facts without a key or an instant have nulls.
    """
    value = F.col(amount).cast("decimal(28,8)")
    present = facts.dropna(subset=[*keys, at]).withColumn("day", F.col(at).cast("date"))
    sums = present.groupBy(*keys, "day", at).agg(F.coalesce(F.sum(value), F.lit(0)).cast("decimal(38,8)").alias("s"), F.count(amount).alias("n"))
    sums = staged(sums, "trailing-instants")
    days = sums.groupBy(*keys, "day").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    earlier = W.partitionBy(*keys).orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0)
    before = days.select(*keys, "day", F.coalesce(F.sum("s").over(earlier), zero).alias("s0"), F.coalesce(F.sum("n").over(earlier), zero).alias("n0"))
    upto = W.partitionBy(*keys, "day").orderBy(at).rowsBetween(W.unboundedPreceding, W.currentRow)
    running = sums.withColumns({"s": F.sum("s").over(upto), "n": F.sum("n").over(upto)}).join(before, [*keys, "day"])
    running = running.select(
        *keys, F.col(at).alias("_at"), (F.col("s") + F.col("s0")).cast("decimal(38,8)").alias("_s"), (F.col("n") + F.col("n0")).alias("_n")
    )
    running = staged(running, "trailing-running")
    ends = running.select(*keys, (F.col("_at") - F.lit(frame)).alias("_since"), F.col("_at").alias("_upto"), F.col("_s").alias("_s1"), F.col("_n").alias("_n1"))
    framed = asof_join(ends, running, keys, "_since", "_at", ["_s", "_n"], strict=True, matched_at="_seen", ranges=ranges)
    framed = framed.select(
        *keys, F.col("_upto").alias(at), (F.col("_s1") - F.coalesce("_s", zero)).cast("double").alias(sum_out),
        (F.col("_n1") - F.coalesce("_n", zero)).alias(count_out),
    )
    return facts.join(framed, [*keys, at], "left")



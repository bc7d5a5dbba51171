"""Steps done in strict order within a time limit, as a bounded state machine that merges."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import timedelta
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.functions.numeric import pct


class _Stretch:
    """What a stretch of one user's rows does, in order of time, whatever came before it.

    ``latest[j]``: the latest start of a sequence that lies in the stretch and has reached step j within the limit.
    ``ends[i][j]``: the earliest time at which steps i + 1 to j are done in the stretch, for a sequence that comes in
    with i steps.  Both are bounded by the number of steps.
    """

    def __init__(self, user, first: int, steps: int):
        self.user, self.first, self.steps = user, first, steps
        self.latest: list[int | None] = [None] * (steps + 1)
        self.ends: list[list[int | None]] = [[None] * (steps + 1) for _ in range(steps)]

    def take(self, at: int, step: int, limit: int) -> None:
        """Rows of one instant come with the later steps first, so that none follows another of its instant."""
        if step == 1:
            self.latest[1] = at
        else:
            start, held = self.latest[step - 1], self.latest[step]
            if start is not None and at - start <= limit and (held is None or start > held):
                self.latest[step] = start
        for i in range(1, step):
            ends = self.ends[i]
            if ends[step] is None and (i == step - 1 or ends[step - 1] is not None):
                ends[step] = at

    def row(self) -> tuple:
        n = self.steps
        return self.user, self.first, self.latest[1:], [self.ends[i][j] for i in range(1, n) for j in range(i + 1, n + 1)]


def _stretches(batches: Iterator[pa.RecordBatch], steps: int, limit: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row for each user of a sorted partition; only the present user's state is held."""
    now, done = None, []

    def out():
        columns = [pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for batch in batches:
        for user, at, step in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            if now is None or now.user != user:
                if now is not None:
                    done.append(now.row())
                now = _Stretch(user, at, steps)
            now.take(at, step, limit)
            if len(done) >= 4096:
                yield out()
                done = []
    if now is not None:
        done.append(now.row())
        yield out()


def _joined(state: Column, part: Column, steps: int, limit: int) -> Column:
    """State after a stretch: for each step the latest start, from inside the stretch or carried through it."""
    places = {(i, j): n for n, (i, j) in enumerate((i, j) for i in range(1, steps) for j in range(i + 1, steps + 1))}
    after = []
    for j in range(1, steps + 1):
        starts = [part["latest"][j - 1], state[j - 1]]
        for i in range(1, j):
            end = part["ends"][places[i, j]]
            starts.append(F.when(end <= state[i - 1] + F.lit(limit), state[i - 1]))
        after.append(F.greatest(*starts))
    return F.array(*after)


def ordered_steps(
    df: DataFrame, steps: Sequence[str], within: timedelta, key: str = "user_id", at: str = "event_timestamp", name: str = "event_name"
) -> DataFrame:
    """``steps_reached`` of each user: how many of ``steps`` they did in this order, each strictly later than the one before,
    all within ``within`` of the first.

    Other rows may lie between.  A later start may reach further than the first one, so each step remembers the latest start that
    reached it.  Distinct (user, instant, step) are dealt out in ranges of (user, time); each task reads its sorted rows as a
    stream and gives one short state for each user, and a user who spans several ranges has their states joined in
    order.  So a user with most of the rows takes most of the ranges and no group is held in memory.

    Rows without a user, instant or a name among ``steps`` don't count; a user without any other is left out; one
    who has steps but never the first has 0.  Steps must differ.
    """
    if len(set(steps)) != len(steps) or not steps:
        raise ValueError("steps must be named, and differ")
    limit = within // timedelta(microseconds=1)
    number = F.array_position(F.array(*[F.lit(s) for s in steps]), F.col(name)).cast("int")
    instant = F.col(at) if df.schema[at].dataType == T.TimestampType() else F.col(at).cast("timestamp_ntz")
    # An instant without a zone counts from the same wall clock.
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    micros = F.unix_micros(instant) if df.schema[at].dataType == T.TimestampType() else F.timestamp_diff("MICROSECOND", epoch, instant)
    rows = df.select(F.col(key).alias("user"), micros.alias("at"), number.alias("step"))
    rows = rows.where("user IS NOT NULL AND at IS NOT NULL AND step > 0").distinct()
    dealt = rows.repartitionByRange("user", "at").sortWithinPartitions("user", "at", F.desc("step"))
    kind = rows.schema["user"].dataType
    schema = f"user {kind.simpleString()}, first long, latest array<long>, ends array<long>"
    arrow = pa.schema([("user", to_arrow_type(kind)), ("first", pa.int64()), ("latest", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
    parts = dealt.mapInArrow(partial(_stretches, steps=len(steps), limit=limit, schema=arrow), schema)
    # A user has no more parts than there are ranges.
    states = parts.groupBy("user").agg(F.array_sort(F.collect_list(F.struct("first", "latest", "ends"))).alias("parts"))
    none = F.array(*[F.lit(None).cast("long") for _ in steps])
    joined = F.aggregate("parts", none, lambda s, p: _joined(s, p, len(steps), limit))
    reached = F.aggregate(F.transform(joined, lambda x, i: F.when(x.isNotNull(), i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
    return states.select(F.col("user").alias(key), reached.cast("int").alias("steps_reached"))


def ordered_funnel(reached: DataFrame, steps: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Users who reached each step of ``ordered_steps``, and their share of those who reached the one before."""
    counts = reached.groupBy(*by).agg(*[F.count_if(F.col("steps_reached") >= i).alias(f"__{i}") for i in range(1, len(steps) + 1)])
    rows = []
    for i, s in enumerate(steps, 1):
        before = F.col(f"__{max(i - 1, 1)}")
        rows.append(
            F.struct(F.lit(i).alias("step_number"), F.lit(s).alias("step"), F.col(f"__{i}").alias("users"), pct(F.col(f"__{i}"), before).alias("step_rate"))
        )
    return counts.select(*by, F.inline(F.array(*rows)))

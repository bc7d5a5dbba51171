"""Global order without a single task: running totals, n-tiles and exact quantiles.

``row_number().over(orderBy(x))`` without a partition sends every row to one task.  Here Spark's range partitioning
deals the rows out in their own type's order, the parts are written, ordered inside each part in parallel, and shifted
by the totals of the parts before.  Where the parts begin only balances the work: any cuts give the same result.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.plans.staging import staged

#: The number of ranges follows the number of rows.
ROWS_PER_RANGE = 200_000
ACCURACY = 20_000


def spread(df: DataFrame, by: str, tie: str | None = None, ranges: int | None = None) -> DataFrame:
    """Write ``df`` with ``_range``, a number that grows with ``(by, tie)`` and splits the rows into balanced parts.

    Runs jobs at once.  Values are compared in their own type.  Rows that share ``by`` are split by ``tie``, so a
    value that a third of the rows have takes a third of the ranges.  The input is computed once and written, as it
    is read for its size, for the cuts and for dealing it out.
    """
    held = staged(df, "ranking-input")
    parts = ranges or max(1, math.ceil(held.count() / ROWS_PER_RANGE))
    keys = [F.col(c).asc_nulls_first() for c in (by, tie) if c is not None]
    return staged(held.repartitionByRange(parts, *keys).withColumn("_range", F.spark_partition_id()), "ranking")


def running_totals(
    df: DataFrame,
    by: str,
    totals: Mapping[str, Column],
    tie: str | None = None,
    descending: bool = False,
    ranges: int | None = None,
    grand: Mapping[str, str] | None = None,
) -> DataFrame:
    """Inclusive running sums in the order of ``(by, tie)``, NULL first when ascending.

    ``totals`` maps an output column to a non-NULL numeric expression; ``grand`` maps an output column to
    the name of a total whose overall sum is wanted on every row.  ``(by, tie)`` must be distinct.
    Runs jobs at once: the rows are counted, written in ranges, and read for the totals of ranges and for the order.
    """
    tagged = spread(df.withColumns(dict(totals)), by, tie, ranges)
    direction = (lambda c: F.col(c).desc_nulls_last()) if descending else (lambda c: F.col(c).asc_nulls_first())
    keys = [direction(by)] + ([direction(tie)] if tie else [])
    inside = W.partitionBy("_range").orderBy(*keys).rowsBetween(W.unboundedPreceding, W.currentRow)
    # One row for each ROWS_PER_RANGE rows.
    per_range = tagged.groupBy("_range").agg(*[F.sum(n).alias(n) for n in totals])
    before = W.orderBy(direction("_range")).rowsBetween(W.unboundedPreceding, -1)
    overall = W.partitionBy()
    offsets = per_range.select(
        "_range",
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in totals],
        *[F.sum(n).over(overall).alias(out) for out, n in (grand or {}).items()],
    )
    joined = tagged.withColumns({n: F.sum(n).over(inside) for n in totals}).join(offsets, "_range")
    shifted = joined.withColumns({n: F.col(n) + F.col(f"_before_{n}") for n in totals})
    return shifted.drop("_range", *[f"_before_{n}" for n in totals])


def global_rank(
    df: DataFrame, by: str, tie: str, out: str = "global_rank", descending: bool = False, ranges: int | None = None
) -> DataFrame:
    """1, 2, 3, … over the whole set."""
    return running_totals(df, by, {out: F.lit(1).cast("long")}, tie, descending, ranges)


def ntile_scalable(
    df: DataFrame, by: str, tie: str, n: int = 4, out: str = "tile", ranges: int | None = None
) -> DataFrame:
    """NTILE(n) over ``ORDER BY by, tie`` from the global rank: the first ``rows mod n`` tiles take one more."""
    rank = {"_rank": F.lit(1).cast("long")}
    ranked = running_totals(df, by, rank, tie, ranges=ranges, grand={"_rows": "_rank"})
    size, extra = F.expr(f"_rows div {n}"), F.expr(f"_rows % {n}")
    sized = ranked.withColumn("_size", size).withColumn("_extra", extra)
    tile = F.expr(
        "CASE WHEN _rank <= _extra * (_size + 1) THEN (_rank - 1) div (_size + 1) + 1 "
        "ELSE (_rank - 1 - _extra) div greatest(_size, 1) + 1 END"
    )
    return sized.withColumn(out, tile.cast("int")).drop("_rank", "_rows", "_size", "_extra")


def exact_quantiles(
    df: DataFrame, column: str, probabilities: Sequence[float], ranges: int | None = None
) -> list[float | None]:
    """Quantiles with linear interpolation over the non-NULL values, compared and returned as doubles.

    Runs jobs at once.  ``percentile`` would hold every distinct value in one task.  Instead values are counted, a
    value that many rows share becoming one row, and the counts are put in ranges; only the ranges that hold a wanted
    rank are ordered, each by its own task.
    """
    values = df.select(F.col(column).cast("double").alias("x")).where("x IS NOT NULL")
    ladder = spread(values.groupBy("x").agg(F.count(F.lit(1)).alias("n")), "x", ranges=ranges)
    n = ladder.agg(F.sum("n")).head()[0]
    if not n:
        return [None for _ in probabilities]
    ranks = [(math.floor((n - 1) * p), min(math.floor((n - 1) * p) + 1, n - 1), (n - 1) * p) for p in probabilities]
    wanted = sorted({r for low, high, _ in ranks for r in (low, high)})
    upto = W.orderBy("_range").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = ladder.groupBy("_range").agg(F.sum("n").alias("held"))
    before = sums.select("_range", "held", (F.sum("held").over(upto) - F.col("held")).alias("before"))
    inside = F.exists(F.array(*[F.lit(r).cast("long") for r in wanted]), lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("held")))
    reached = F.sum("n").over(W.partitionBy("_range").orderBy("x").rowsBetween(W.unboundedPreceding, W.currentRow))
    steps = ladder.join(before.where(inside), "_range").withColumn("upto", F.col("before") + reached)
    at = steps.agg(*[F.min(F.when((F.col("upto") > r) & (F.col("before") <= r), F.col("x"))).alias(f"r{r}") for r in wanted]).head()
    return [at[f"r{low}"] + (place - low) * (at[f"r{high}"] - at[f"r{low}"]) for low, high, place in ranks]


def approx_quantiles(df: DataFrame, column: str, probabilities: Sequence[float], accuracy: int = ACCURACY) -> list:
    """The cheap form, for when a value near the quantile will do."""
    cut = F.percentile_approx(F.col(column).cast("double"), list(probabilities), accuracy)
    return df.agg(cut.alias("q")).head()["q"]


def best(df: DataFrame, *order) -> DataFrame:
    """First row of an order (a top-1 per task, then of those)."""
    return df.orderBy(*order).limit(1)


def best_per(df: DataFrame, group: Sequence[str], *order) -> DataFrame:
    """First row of each group in an order; kept to one row per group and split before the shuffle."""
    position = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    return df.withColumn("_position", position).where("_position = 1").drop("_position")


def best_pair(df: DataFrame, group: str, label: str, first: tuple[str, Sequence], second: tuple[str, Sequence]):
    """Two winners per group by two orders, side by side.  ``first``/``second``: (suffix, order columns)."""

    def side(suffix, order):
        keep = df.columns
        won = best_per(df, [group], *order, label)
        return won.select(group, *[F.col(c).alias(f"{c}_{suffix}") for c in keep if c != group])

    return side(*first).join(side(*second), group, "left")

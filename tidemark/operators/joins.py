"""Joins with a stated cardinality, ranges and consistency checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.timeline import interval_join

SALTS = 16


def unique_by(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """The same rows, failing the job when a key occurs twice.

    The check is the aggregation itself: it leaves the data partitioned by the keys, which the join that
    follows needs anyway, so it adds no shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.any_value(c).alias(c) for c in rest])
    message = F.concat(F.lit(f"{what}: key ({', '.join(keys)}) is not unique"))
    ok = F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return grouped.where(ok).select(*df.columns)


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], validate: str, how: str = "left") -> DataFrame:
    """Join with ``validate`` in one_to_one, many_to_one, one_to_many or many_to_many."""
    sides = {"one_to_one": (1, 1), "many_to_one": (0, 1), "one_to_many": (1, 0), "many_to_many": (0, 0)}
    check_left, check_right = sides[validate]
    if check_left:
        left = unique_by(left, on, "left side")
    if check_right:
        right = unique_by(right, on, "right side")
    return left.join(right, list(on), how)


def salted_join(facts: DataFrame, dim: DataFrame, key: str, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Equi-join for a fact side whose keys may be very uneven.

    Each key is spread over ``salts`` groups by a hash of the fact row; the dimension (one row per key) is
    repeated once per salt.  Every fact row still meets exactly its dimension row.  The hash depends on the
    row alone, so a retried task salts it the same way; full copies of a row share a salt, so where copies
    may be many, count them first (``cleaning.key_counts``) and join the counts.
    """
    if how not in ("inner", "left"):
        raise ValueError("salted_join keeps the fact side: use inner or left")
    spread = F.pmod(F.xxhash64(*facts.columns), F.lit(salts)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    left = facts.withColumn("_salt", spread)
    right = dim.withColumn("_salt", copies)
    return left.join(right, [key, "_salt"], how).drop("_salt")


def within_join(facts: DataFrame, anchors: DataFrame, key: str, at: str, start: str, low: Column, high: Column) -> DataFrame:
    """Facts with ``start + low < at <= start + high`` of an anchor of their key, once for each such anchor."""
    spans = anchors.dropna(subset=[start]).withColumns({"_opens": F.col(start) + low, "_closes": F.col(start) + high})
    return interval_join(facts, spans, [key], at, "_opens", "_closes", closed="right").drop("_opens", "_closes")


def order_violation_join(facts: DataFrame, dim: DataFrame, key: str, earlier: str, later: str) -> DataFrame:
    """Fact rows whose ``earlier`` instant comes before the ``later`` one they must follow."""
    due = dim.dropna(subset=[later])
    due = due.withColumn("_ever", F.lit(None).cast(due.schema[later].dataType))
    return interval_join(facts, due, [key], earlier, "_ever", later, closed="neither").drop("_ever")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Keys of ``child`` without a parent row, with their number of rows.

    Child rows are counted per key first, so the anti join sees each key once.  NULL keys are orphans.
    """
    counts = child.groupBy(key).agg(F.count(F.lit(1)).alias("orphan_rows"))
    return counts.join(parent.select(key).distinct(), key, "left_anti")

"""Grouping sets with distinct keys: raw rows are reduced once, whatever the number of sets."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(28,8)"


def cube_sets(dims: Sequence[str]) -> list[list[str]]:
    """Every subset of the dimensions, the widest first."""
    return [list(c) for n in range(len(dims), -1, -1) for c in combinations(dims, n)]


def rollup_sets(dims: Sequence[str]) -> list[list[str]]:
    """The dimensions, then without the last one, and so on to the total."""
    return [list(dims[:n]) for n in range(len(dims), -1, -1)]


def distinct_by_sets(
    df: DataFrame, sets: Sequence[Sequence[str]], key: str = "user_id", sums: Sequence[str] = (), users: str = "users", rows: str = "rows"
) -> DataFrame:
    """Distinct keys, rows and fixed-point sums of each cell of each set.

    Rows are first reduced to one per key and finest cell, with map-side combining; only those are repeated for the
    sets, and once more reduced to one per key and cell of a set, so that distinct keys are plain counts.  k sets thus
    cost k times the keys' cells, not k times the rows, and a key with most of the rows is as short as its cells.

    ``set_name`` has the dimensions a row is grouped by, comma-joined (``total`` for none): it tells a null value from a
    dimension that the set leaves out.  A null key counts its rows but no key.  An empty table has no row, also none
    for the total.  A set that is named twice counts once.
    """
    wanted = list(dict.fromkeys(frozenset(s) for s in sets))
    dims = list(dict.fromkeys(d for s in sets for d in s))
    taken = {key, users, rows, "set_name", "__gid", "__n"} | {f"__s{i}" for i in range(len(sums))}
    if clash := taken & set(dims):
        raise ValueError(f"dimensions named as output columns: {sorted(clash)}")
    values = {f"__s{i}": c for i, c in enumerate(sums)}
    cells = df.groupBy(key, *dims).agg(F.count(F.lit(1)).alias("__n"), *[F.sum(F.col(c).cast(MONEY)).alias(s) for s, c in values.items()])
    added = [F.sum("__n").alias("__n"), *[F.sum(s).alias(s) for s in values]]
    grouped = [[F.col(c) for c in (key, *dims) if c == key or c in s] for s in wanted]
    per_key = cells.groupingSets(grouped, *[F.col(c) for c in (key, *dims)]).agg(F.grouping_id().alias("__gid"), *added)
    out = per_key.groupBy(*dims, "__gid").agg(F.count(key).alias(users), *added)
    # A bit of the id is set where its dimension is left out; the last dimension has the lowest bit.
    named = [F.when(F.col("__gid").bitwiseAND(1 << (len(dims) - 1 - i)) == 0, d) for i, d in enumerate(dims)]
    label = F.concat_ws(",", *named) if named else F.lit("")
    return out.select(
        F.when(label == "", "total").otherwise(label).alias("set_name"), *dims, users, F.col("__n").alias(rows),
        *[F.col(s).cast("double").alias(c) for s, c in values.items()],
    )

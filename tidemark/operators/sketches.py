"""Distinct users and quantiles from sketches that are stored per day and merged later.

A day's sketches take a bounded number of bytes however many rows it has, and merging the days of any span gives the same
estimate as one pass over its rows would, within the same bounds.  Users of several groups or spans are intersected on
theta sketches; HyperLogLog ones are smaller and only unite.

Bounds, each held in 99 of 100 cases or more: HLL_ERROR and THETA_ERROR are relative to the number of distinct users (for an
intersection, to those of the union), RANK_ERROR is the difference between the wanted and the true rank of a quantile.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 2**LG_K registers or entries; the k of a quantile sketch.
LG_K = 12
KLL_K = 200
#: Three standard errors: 1.04 / sqrt(K) of merged HyperLogLog sketches, 1 / sqrt(K - 1) of theta ones.
HLL_ERROR = 3 * 1.04 / math.sqrt(1 << LG_K)
THETA_ERROR = 3 / math.sqrt((1 << LG_K) - 1)
#: The double-sided normalised rank error of a quantile sketch of k = 200.
RANK_ERROR = 0.0165
#: Bytes that a state takes at most: 8-bit registers, 64-bit entries, and a few levels of k doubles.
HLL_BYTES = (1 << LG_K) + 64
THETA_BYTES = 8 * (1 << LG_K) + 64
KLL_BYTES = 8 * KLL_K * 8


def sketch_states(df: DataFrame, by: Sequence[str], user: str = "user_id", value: str = "transaction_amount_krw") -> DataFrame:
    """One row for each group of ``by``: rows, users_hll, users_theta and value_kll.

    Map-side combined, so a hot group is one state per task.  Null users and values are in no sketch.
    """
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.hll_sketch_agg(user, LG_K).alias("users_hll"),
        F.theta_sketch_agg(user, LG_K).alias("users_theta"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(KLL_K)).alias("value_kll"),
    )


def merged_states(states: DataFrame, by: Sequence[str]) -> DataFrame:
    """States of wider groups from those of narrower ones, in any order and grouping."""
    return states.groupBy(*by).agg(
        F.sum("rows").alias("rows"),
        F.hll_union_agg("users_hll").alias("users_hll"),
        F.theta_union_agg("users_theta").alias("users_theta"),
        F.kll_merge_agg_double("value_kll").alias("value_kll"),
    )


def users_estimate(state: str = "users_hll") -> Column:
    """Distinct users of a HyperLogLog or theta state."""
    return F.theta_sketch_estimate(state) if state.endswith("theta") else F.hll_sketch_estimate(state)


def quantile(probability: float, state: str = "value_kll") -> Column:
    """The value near a rank; null where no value went in."""
    some = F.kll_sketch_get_n_double(state) > 0
    return F.when(some, F.kll_sketch_get_quantile_double(F.col(state), F.lit(probability)))


def shared_users(states: DataFrame, by: Sequence[str], span: str, first, second) -> DataFrame:
    """(by, shared, either): users of two values of ``span`` in each group that has both, by theta intersection and union.

    ``states`` has one row for each group and span.
    """
    side = lambda value, name: states.where(F.col(span) == F.lit(value)).select(*by, F.col("users_theta").alias(name))
    both = side(first, "a").join(side(second, "b"), list(by))
    return both.select(
        *by,
        F.theta_sketch_estimate(F.theta_intersection("a", "b")).alias("shared"),
        F.theta_sketch_estimate(F.theta_union("a", "b")).alias("either"),
    )


def state_bytes(states: DataFrame) -> Mapping[str, int]:
    """The largest state of each kind, in bytes."""
    sizes = states.agg(*[F.max(F.octet_length(c)).alias(c) for c in ("users_hll", "users_theta", "value_kll")]).head()
    return {name: size or 0 for name, size in sizes.asDict().items()}

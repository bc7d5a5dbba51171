"""Rounding, rates and order-independent money sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Largest whole number a double counts without gaps; beyond it there is nothing to round.
_EXACT_LIMIT = float(2**53)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(c: Column | str, digits: int = 0) -> Column:
    """Round a double half away from zero on its binary value (the same bits in any SQL engine)."""
    x = _col(c).cast("double")
    scale = float(10**digits)
    magnitude = F.abs(x)
    rounded = F.floor(magnitude * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)
    small = magnitude < F.lit(_EXACT_LIMIT / scale)
    return F.when(small & (x < 0), -rounded).when(small, rounded).otherwise(x)


def ratio(numerator: Column | str, denominator: Column | str, digits: int | None = None) -> Column:
    """Double division that gives NULL, not an error, on a zero denominator."""
    value = F.try_divide(_col(numerator).cast("double"), _col(denominator).cast("double"))
    return value if digits is None else round_half_up(value, digits)


def pct(numerator: Column | str, denominator: Column | str, digits: int = 2) -> Column:
    """``100 * numerator / denominator`` rounded."""
    return ratio(F.lit(100.0) * _col(numerator).cast("double"), denominator, digits)


def exact_sum(c: Column | str) -> Column:
    """SUM of money held in doubles, independent of the order rows arrive in.

    Adding doubles gives last-digit differences whenever partitioning changes or a task is retried;
    fixed-point addition does not, so ranks and thresholds built on the sums stay reproducible.
    """
    return F.sum(_col(c).cast("decimal(28,8)")).cast("double")


def exact_avg(c: Column | str) -> Column:
    """AVG over the non-NULL values, on the same order-independent sum."""
    return ratio(exact_sum(c), F.count(_col(c)))


def count_where(condition: Column) -> Column:
    """SUM of a 0/1 test: NULL over no rows, as SUM is (COUNT_IF would give 0)."""
    return F.sum(F.when(condition, F.lit(1)).otherwise(F.lit(0)))


def any_flag(condition: Column) -> Column:
    """1 when the condition holds on any row of the group."""
    return F.max(F.when(condition, F.lit(1)).otherwise(F.lit(0)))


def clip(c: Column | str, low: float, high: float) -> Column:
    """Bound a value to [low, high]; NULL stays NULL (LEAST/GREATEST skip NULLs)."""
    x = _col(c)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))

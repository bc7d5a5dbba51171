"""Date and time helpers that never depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def whole_second(ts: Column | str) -> Column:
    """Drop the fraction of a second, keeping the type (DATE_TRUNC would turn NTZ into TIMESTAMP)."""
    x = _col(ts)
    fraction = F.extract(F.lit("SECOND"), x) % F.lit(1).cast("decimal(2,0)")
    return x - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), fraction)


def days(n: int) -> Column:
    return F.make_dt_interval(F.lit(n))


def elapsed_seconds(start: Column | str, end: Column | str) -> Column:
    gap = (_col(end) - _col(start)).cast("interval second")
    return gap.cast("decimal(20,6)").cast("double")


def elapsed(start: Column | str, end: Column | str, unit: str = "day") -> Column:
    """Fractional time from ``start`` to ``end`` in days or hours."""
    seconds = {"day": 86_400.0, "hour": 3_600.0}[unit]
    return elapsed_seconds(start, end) / F.lit(seconds)


def within_days(start: Column | str, ts: Column | str, n: int) -> Column:
    """``ts`` at most ``n`` days after ``start``, both taken at whole seconds, limit included."""
    return whole_second(ts) <= whole_second(start) + days(n)


def month_start(ts: Column | str) -> Column:
    return F.trunc(_col(ts).cast("date"), "MM")


def month_key(ts: Column | str) -> Column:
    """``yyyy-MM`` text."""
    d = _col(ts).cast("date")
    return F.substring(d.cast("string"), 1, 7)


def month_index(ts: Column | str) -> Column:
    """Whole months since year 0, so a difference is a month count."""
    x = _col(ts)
    return F.year(x) * 12 + F.month(x)


def months_between_starts(start: Column | str, end: Column | str) -> Column:
    return month_index(end) - month_index(start)


def unparseable(text: Column | str) -> Column:
    """Text present but not readable as a timestamp."""
    x = _col(text)
    return x.isNotNull() & F.try_to_timestamp(x.cast("string")).isNull()

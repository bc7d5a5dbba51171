"""Labels from rules, maps and bins; all become one CASE expression, never a row function."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _value(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def first_match(rules: Iterable[tuple[Column | str, object]], default=None) -> Column:
    """Ordered rules, first true one wins.  A condition may be SQL text.  NULL conditions fall through."""
    out: Column | None = None
    for condition, value in rules:
        test = F.expr(condition) if isinstance(condition, str) else condition
        out = F.when(test, _value(value)) if out is None else out.when(test, _value(value))
    return _value(default) if out is None else out.otherwise(_value(default))


def recode(c: Column | str, mapping: Mapping, default=None) -> Column:
    """Simple CASE: replace listed values, give ``default`` for the rest."""
    x = _col(c)
    return first_match(((x == F.lit(k), v) for k, v in mapping.items()), default)


def map_with_default(c: Column | str, mapping: Mapping, default) -> Column:
    """Dictionary lookup through a literal map column."""
    pairs = [F.lit(item) for pair in mapping.items() for item in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _col(c)), _value(default))


def bin_right(c: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Intervals ``(edge[i], edge[i+1]]``; outside all of them, and NULL, give NULL."""
    x = _col(c)
    return first_match(
        (((x > F.lit(lo)) & (x <= F.lit(hi)), label) for lo, hi, label in zip(edges[:-1], edges[1:], labels, strict=True))
    )


def bin_left(c: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """``x < edge[0]`` first label, ``x < edge[1]`` second, …, last label otherwise (also for NULL)."""
    x = _col(c)
    return first_match(((x < F.lit(e), label) for e, label in zip(edges, labels)), labels[-1])


def not_in_domain(c: Column | str, allowed: Sequence) -> Column:
    x = _col(c)
    return ~x.isin(*allowed) | x.isNull()


def clean_label(c: Column | str) -> Column:
    """Underscores to spaces, first letter upper, rest lower."""
    text = F.replace(_col(c).cast("string"), F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))


def order_rank(c: Column | str, order: Sequence[str]) -> Column:
    """1, 2, 3, … for the listed values, NULL for others."""
    return recode(c, {v: i for i, v in enumerate(order, start=1)})

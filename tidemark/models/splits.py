"""Chronological splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranking import exact_quantiles


def split_dates(df: DataFrame, date_col: str, fractions: Sequence[float] = (0.70, 0.85)) -> list:
    """The distinct dates at the given fractions: bounded by the calendar, so one sorted set holds them."""
    dates = F.sort_array(F.collect_set(date_col))
    picks = [
        F.try_element_at("dates", F.floor(F.size("dates") * F.lit(f)).cast("int") + 1).alias(f"d{i}")
        for i, f in enumerate(fractions)
    ]
    return list(df.agg(dates.alias("dates")).select(*picks).head())


def split_by_dates(
    df: DataFrame, date_col: str = "observation_date", fractions: Sequence[float] = (0.70, 0.85)
) -> list[DataFrame]:
    """Consecutive parts of the history; a part starts on its boundary date."""
    bounds = split_dates(df, date_col, fractions)
    c = F.col(date_col)
    edges = [None, *bounds, None]
    parts = []
    for low, high in zip(edges, edges[1:]):
        test = F.lit(True)
        if low is not None:
            test = test & (c >= F.lit(low))
        if high is not None:
            test = test & (c < F.lit(high))
        parts.append(df.where(test))
    return parts


def split_labels(
    df: DataFrame, date_col: str = "observation_date", names: Sequence[str] = ("train", "validation", "test")
) -> DataFrame:
    """The same split as a column."""
    validation, test = split_dates(df, date_col)
    c = F.col(date_col)
    label = F.when(c < F.lit(validation), names[0]).when(c < F.lit(test), names[1]).otherwise(names[2])
    return df.withColumn("split", label)


def split_at(df: DataFrame, date_col: str, cutoff=None, quantile: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Up to and including a cutoff date, and after it; without a cutoff at a quantile of the dates."""
    if cutoff is None:
        numbered = df.select(F.unix_date(date_col).alias("d"))
        at = exact_quantiles(numbered, "d", [quantile])[0]
        day = F.unix_date(date_col)
        return df.where(day <= F.lit(at)), df.where(day > F.lit(at))
    return df.where(F.col(date_col) <= F.lit(cutoff)), df.where(F.col(date_col) > F.lit(cutoff))


def split_by_position(df: DataFrame, order: str = "date", fraction: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """The first share of a series with one row per date, and the rest."""
    boundary = split_dates(df, order, [fraction])[0]
    return df.where(F.col(order) < F.lit(boundary)), df.where(F.col(order) >= F.lit(boundary))

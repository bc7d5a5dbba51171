"""Daily market series: alignment, rolling features and the next-day target.

Series are kept long, one row per (pair, date), so windows run per pair; a pair's history is bounded by the
calendar.  The wide form is made only for the final feature vector.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.numeric import ratio

FIELDS = ("open", "high", "low", "close")
WINDOWS = (5, 10, 20)
TRADING_DAYS = 252.0
FEATURE_TOKENS = ("return_1d", "vol_", "momentum_", "ma_gap", "intraday_range")
TARGET = "target_next_abs_return"


def filter_pairs(fx: DataFrame, min_rows: int = 500) -> DataFrame:
    """Pairs with enough history."""
    enough = fx.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows)
    return fx.join(enough.select("pair"), "pair", "left_semi")


def align_pairs(fx: DataFrame, main: str, pairs: Sequence[str], fields: Sequence[str] = FIELDS) -> DataFrame:
    """Pairs side by side on the date, only dates on which ``main`` has a close."""
    wide = fx.groupBy("date").pivot("pair", list(pairs)).agg(*[F.first(f).alias(f) for f in fields])
    if len(fields) == 1:
        wide = wide.withColumnsRenamed({p: f"{p}_{fields[0]}" for p in pairs})
    return wide.where(F.col(f"{main}_close").isNotNull())


def align_long(fx: DataFrame, main: str, pairs: Sequence[str]) -> DataFrame:
    """``align_pairs`` in long form: every pair on the dates of ``main``, NULL where it has no row."""
    dates = fx.where((F.col("pair") == main) & F.col("close").isNotNull()).select("date").distinct()
    spine = dates.select("date", F.explode(F.array(*[F.lit(p) for p in pairs])).alias("pair"))
    return spine.join(fx.select("pair", "date", *FIELDS), ["pair", "date"], "left")


def _by_pair():
    return W.partitionBy("pair").orderBy("date")


def returns(df: DataFrame) -> DataFrame:
    """Simple and log return against the row before."""
    previous = F.lag("close").over(_by_pair())
    return df.withColumns(
        {
            "return_1d": ratio("close", previous) - 1,
            "log_return_1d": F.when((F.col("close") > 0) & (previous > 0), F.log("close") - F.log(previous)),
        }
    )


def _full_window(c: Column, value: Column, w: int) -> Column:
    """A rolling value only where the window is complete and holds no NULL."""
    frame = _by_pair().rowsBetween(-(w - 1), 0)
    return F.when(F.count(c).over(frame) == w, value.over(frame))


def rolling_vol(df: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    r = F.col("log_return_1d")
    year = F.sqrt(F.lit(TRADING_DAYS))
    return df.withColumns({f"vol_{w}d": _full_window(r, F.stddev_samp(r), w) * year for w in windows})


def momentum(df: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    return df.withColumns(
        {f"momentum_{w}d": ratio("close", F.lag("close", w).over(_by_pair())) - 1 for w in windows}
    )


def ma_gap(df: DataFrame, fast: int = 5, slow: int = 20) -> DataFrame:
    c = F.col("close")
    gap = ratio(_full_window(c, F.avg(c), fast), _full_window(c, F.avg(c), slow)) - 1
    return df.withColumn(f"ma_gap_{fast}_{slow}", gap)


def range_pct(df: DataFrame) -> DataFrame:
    return df.withColumn("intraday_range_pct", ratio(F.col("high") - F.col("low"), F.col("close")))


def next_abs_return(df: DataFrame) -> DataFrame:
    """The next row's absolute log return."""
    return df.withColumn(TARGET, F.abs(F.lead("log_return_1d").over(_by_pair())))


def columns_matching(df: DataFrame, tokens: Sequence[str] = FEATURE_TOKENS) -> list[str]:
    return [c for c in df.columns if any(t in c for t in tokens)]


def complete_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(subset=list(columns) if columns else None)


def pair_features(aligned: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """All per-pair features; every window shares one partitioning and order, so one shuffle and one sort."""
    return next_abs_return(range_pct(ma_gap(momentum(rolling_vol(returns(aligned), windows), windows))))


def fx_features(
    fx: DataFrame, main: str, pairs: Sequence[str], windows: Sequence[int] = WINDOWS
) -> DataFrame:
    """One row per date: nine features per pair, the main pair's intraday range and next-day target."""
    long = pair_features(align_long(fx, main, pairs), windows)
    per_pair = ["return_1d", "log_return_1d"]
    for w in windows:
        per_pair += [f"vol_{w}d", f"momentum_{w}d"]
    per_pair.append("ma_gap_5_20")
    own = {"intraday_range_pct": f"{main}_intraday_range_pct", TARGET: TARGET}
    cells = [F.max(F.when(F.col("pair") == p, F.col(c))).alias(f"{p}_{c}") for p in pairs for c in per_pair]
    cells += [F.max(F.when(F.col("pair") == main, F.col(c))).alias(name) for c, name in own.items()]
    wide = long.groupBy("date").agg(*cells)
    return complete_rows(wide)

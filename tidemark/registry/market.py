"""Market series features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.numeric import round_half_up
from tidemark.operators import market
from tidemark.registry.base import query, signed_rnd
from tidemark.sources.stand_in import MAIN_PAIR, PAIRS

_W = 'OVER (PARTITION BY pair ORDER BY "date"'
_SERIES = f"""
    SELECT x.*, log_r AS log_return_1d, abs(lead(log_r) {_W})) AS target_next_abs_return,
           {", ".join(f"CASE WHEN COUNT(log_r) {_W} ROWS {w - 1} PRECEDING) = {w} THEN stddev_samp(log_r) {_W} ROWS {w - 1} PRECEDING) * sqrt(252) END AS vol_{w}d" for w in market.WINDOWS)}
    FROM (SELECT *, close / lag(close) {_W}) - 1 AS return_1d, ln(close) - ln(lag(close) {_W})) AS log_r,
                 {", ".join(f"close / lag(close, {w}) {_W}) - 1 AS momentum_{w}d" for w in market.WINDOWS)},
                 CASE WHEN COUNT(close) {_W} ROWS 19 PRECEDING) = 20
                      THEN (AVG(close) {_W} ROWS 4 PRECEDING)) / (AVG(close) {_W} ROWS 19 PRECEDING)) - 1 END
                     AS ma_gap_5_20,
                 (high - low) / close AS intraday_range_pct
          FROM (SELECT s.pair, s."date", f.open, f.high, f.low, f.close
                FROM (SELECT p.pair, d."date" FROM (SELECT "date" FROM app_fx WHERE pair = '{MAIN_PAIR}') d,
                             (VALUES {", ".join(f"('{p}')" for p in PAIRS)}) p(pair)) s
                LEFT JOIN app_fx f ON f.pair = s.pair AND f."date" = s."date")) x"""


def _pick(columns, digits=8):
    return ", ".join(f"{signed_rnd(c, digits)} AS {c}" for c in columns)


def _one(t, build, columns):
    aligned = market.align_long(t.fx_daily, MAIN_PAIR, PAIRS)
    out = build(aligned).select("pair", "date", *columns)
    return out.withColumns({c: round_half_up(c, 8) for c in columns})


_HEAD = 'SELECT pair, CAST("date" AS VARCHAR) AS "date", '


@query("w4_returns", f"{_HEAD} {_pick(['return_1d', 'log_return_1d'])} FROM ({_SERIES})")
def w4(t):
    return _one(t, market.returns, ["return_1d", "log_return_1d"])


@query("w5_rolling_vol", f"{_HEAD} {_pick(['vol_5d', 'vol_10d', 'vol_20d'])} FROM ({_SERIES})")
def w5(t):
    return _one(t, lambda d: market.rolling_vol(market.returns(d)), ["vol_5d", "vol_10d", "vol_20d"])


@query("w6_ma_gap", f"{_HEAD} {_pick(['ma_gap_5_20'])} FROM ({_SERIES})")
def w6(t):
    return _one(t, market.ma_gap, ["ma_gap_5_20"])


@query("w7_momentum", f"{_HEAD} {_pick(['momentum_5d', 'momentum_10d', 'momentum_20d'])} FROM ({_SERIES})")
def w7(t):
    return _one(t, market.momentum, ["momentum_5d", "momentum_10d", "momentum_20d"])


@query("w8_next_abs_return", f"{_HEAD} {_pick(['target_next_abs_return'])} FROM ({_SERIES})")
def w8(t):
    return _one(t, lambda d: market.next_abs_return(market.returns(d)), ["target_next_abs_return"])


@query("w9_range_pct", f"{_HEAD} {_pick(['intraday_range_pct'])} FROM ({_SERIES})")
def w9(t):
    return _one(t, market.range_pct, ["intraday_range_pct"])


_PER_PAIR = ["return_1d", "log_return_1d"]
for _w in market.WINDOWS:
    _PER_PAIR += [f"vol_{_w}d", f"momentum_{_w}d"]
_PER_PAIR.append("ma_gap_5_20")
_CELLS = {f"{p}_{c}": (p, c) for p in PAIRS for c in _PER_PAIR}
_CELLS[f"{MAIN_PAIR}_intraday_range_pct"] = (MAIN_PAIR, "intraday_range_pct")
_CELLS[market.TARGET] = (MAIN_PAIR, market.TARGET)
_WIDE = f"""SELECT "date", {", ".join(f"MAX({c}) FILTER (WHERE pair = '{p}') AS \"{n}\"" for n, (p, c) in _CELLS.items())}
            FROM ({_SERIES}) GROUP BY "date" """


@query(
    "l25_fx_features",
    'SELECT CAST("date" AS VARCHAR) AS "date", '
    + ", ".join(f'{signed_rnd(chr(34) + n + chr(34), 8)} AS "{n}"' for n in _CELLS)
    + f" FROM ({_WIDE}) WHERE "
    + " AND ".join(f'"{n}" IS NOT NULL' for n in _CELLS),
)
def l25(t):
    wide = t.fx_features
    return wide.withColumns({c: round_half_up(c, 8) for c in wide.columns if c != "date"})


@query(
    "w10_complete_rows",
    f'SELECT COUNT(*) AS dates FROM ({_WIDE}) WHERE ' + " AND ".join(f'"{n}" IS NOT NULL' for n in _CELLS),
)
def w10(t):
    return t.fx_features.agg(F.count(F.lit(1)).alias("dates"))


@query("p13_columns_matching", f'SELECT CAST("date" AS VARCHAR) AS "date", {_pick([f"{MAIN_PAIR}_vol_{w}d" for w in market.WINDOWS])} FROM ({_WIDE}) WHERE ' + " AND ".join(f'"{n}" IS NOT NULL' for n in _CELLS))
def p13(t):
    wide = t.fx_features
    chosen = market.columns_matching(wide, [f"{MAIN_PAIR}_vol_"])
    return wide.select("date", *[round_half_up(c, 8).alias(c) for c in chosen])

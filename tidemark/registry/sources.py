"""Scans, sinks, overview counts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import market, overview, quality, snapshots
from tidemark.operators.repeat import repeat_rate
from tidemark.plans.catalogue import export_all, prepare
from tidemark.plans.staging import build_mart, shared_dir
from tidemark.registry.base import query
from tidemark.schemas import declare
from tidemark.sources.extracts import load_extract
from tidemark.sources.fx import normalise_names, read_fx_daily, source_profile, wide_schema
from tidemark.sources.stand_in import MAIN_PAIR, PAIRS
from tidemark.sources.tables import catalog_info, read_table, run_sql

ORDERS = declare(
    "o_orderkey:long o_custkey:long o_orderstatus:string o_totalprice:double o_orderdate:ts o_orderpriority:string"
)


@query(
    "s1_read_table",
    "SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderstatus = 'P'",
)
def s1(t):
    orders = read_table(t.spark, t.directory, "orders", ORDERS)
    return orders.where("o_orderstatus = 'P'").select("o_orderkey", "o_custkey", "o_orderdate")


@query(
    "s2_run_sql",
    """SELECT transaction_type, transaction_status, COUNT(*) AS attempts FROM app_tx
       WHERE order_type = 'target_rate' GROUP BY ALL""",
)
def s2(t):
    text = """SELECT transaction_type, transaction_status, count(*) AS attempts FROM {tx}
              WHERE order_type = :kind GROUP BY transaction_type, transaction_status"""
    return run_sql(t.spark, text, {"tx": t.tx}, {"kind": "target_rate"})


@query("s3_fx_long", 'SELECT pair, CAST("date" AS VARCHAR) AS "date", open, high, low, close FROM app_fx')
def s3(t):
    """Daily prices written as the wide CSV file they come in, and read back into the long form every operator reads."""
    wide = t.fx_daily.groupBy("date").pivot("pair", list(PAIRS)).agg(*[F.first(f).alias(f) for f in market.FIELDS])
    names = [f.name for f in wide_schema(PAIRS, market.FIELDS)]
    path = f"{shared_dir(t.spark)}/fx-{uuid.uuid4().hex}"
    wide.select(*names).write.csv(path, header=True)
    return read_fx_daily(t.spark, path, PAIRS, market.FIELDS)


def _wide_sql(where: str) -> str:
    cells = ", ".join(
        f"MAX({f}) FILTER (WHERE pair = '{p}') AS \"{p}_{f}\"" for p in PAIRS for f in market.FIELDS
    )
    return f"""SELECT * FROM (SELECT CAST("date" AS VARCHAR) AS "date", {cells} FROM app_fx GROUP BY "date") WHERE {where}"""


@query("s4_align_pairs", _wide_sql(f'"{MAIN_PAIR}_close" IS NOT NULL'))
def s4(t):
    return market.align_pairs(t.fx_daily, MAIN_PAIR, PAIRS)


@query(
    "s5_filter_pairs",
    """SELECT pair, COUNT(*) AS rows FROM app_fx
       WHERE pair IN (SELECT pair FROM app_fx GROUP BY pair HAVING COUNT(*) >= 500) GROUP BY pair""",
)
def s5(t):
    return market.filter_pairs(t.fx_daily, 500).groupBy("pair").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "s6_normalise_names",
    " UNION ALL ".join(
        f"""SELECT '{p}' AS pair, CAST("date" AS VARCHAR) AS "date", high AS high_price, close AS adj_close
            FROM app_fx WHERE pair = '{p}'"""
        for p in PAIRS
    ),
)
def s6(t):
    """Each pair's columns get normal names under its prefix; the prefixes come off again to stack the pairs."""
    parts = []
    for pair in PAIRS:
        own = t.fx_daily.where(F.col("pair") == pair)
        raw = own.select("date", F.col("high").alias("High Price"), F.col("close").alias("Adj Close"))
        named = normalise_names(raw, pair)
        prices = [F.col(f"{pair}_{c}").alias(c) for c in ("high_price", "adj_close")]
        parts.append(named.select(F.lit(pair).alias("pair"), "date", *prices))
    return quality.union(parts)


@query(
    "s7_extract_round_trip",
    """SELECT acquisition_channel, COUNT(*) AS first_exchange_users,
              CAST(SUM(d30_repeat_flag) AS BIGINT) AS d30_repeat_users FROM firsts GROUP BY ALL""",
)
def s7(t):
    """Write the catalogue entry as CSV, read it back with its schema (S7, S8, S9)."""
    folder = f"{shared_dir(t.spark)}/extracts-{uuid.uuid4().hex}"
    inputs = prepare(t.users, t.tx, t.events, t.rates, t.tickets, t.tx)
    only = {"d30_repeat_by_channel": lambda i: repeat_rate(i.mart, i.repeat)}
    export_all(inputs, folder, overwrite=True, exports=only)
    schema = "acquisition_channel string, first_exchange_users long, d30_repeat_users long, d30_repeat_rate double"
    return load_extract(t.spark, f"{folder}/d30_repeat_by_channel", schema).drop("d30_repeat_rate")


@query("s10_staged_mart", "SELECT onboarding_valid_flag, COUNT(*) AS users FROM mart GROUP BY ALL")
def s10(t):
    """The mart as a bucketed table of the session's catalogue, under a name of its own."""
    table = build_mart(t.mart, f"mart_{uuid.uuid4().hex}", buckets=8)
    return table.groupBy("onboarding_valid_flag").agg(F.count(F.lit(1)).alias("users"))


_CATALOGUED = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


@query(
    "s12_catalog_info",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS "table", CAST(row_number() OVER () - 1 AS INT) AS position, column_name AS "column",
                   (SELECT COUNT(*) FROM {n}) AS rows FROM (DESCRIBE SELECT * FROM {n})"""
        for n in _CATALOGUED
    ),
)
def s12(t):
    """Tables and columns as the files themselves have them, with each table's rows; types differ by engine."""
    files = {n: t.spark.read.parquet(f"{t.directory}/{n}.parquet") for n in _CATALOGUED}
    info = catalog_info(t.spark, files).drop("type")
    sizes = quality.union([df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows") for n, df in files.items()])
    return info.join(sizes, "table")


COUNTED = ("users", "events", "transactions", "support_tickets", "marketing_spend", "fx_rates_hourly")
_SQL_NAMES = {
    "users": "app_users",
    "events": "app_events",
    "transactions": "app_tx",
    "support_tickets": "app_tickets",
    "marketing_spend": "app_spend",
    "fx_rates_hourly": "app_rates",
    "modeling_user_month_snapshots": "snaps",
}


@query(
    "a26_row_counts",
    " UNION ALL ".join(f"SELECT '{n}' AS \"table\", COUNT(*) AS rows FROM {s}" for n, s in _SQL_NAMES.items()),
)
def a26(t):
    return overview.row_counts(t.all)


_COVERED = {
    "users": "signup_timestamp",
    "transactions": "transaction_timestamp",
    "modeling_user_month_snapshots": "observation_date",
}


@query(
    "a27_date_coverage",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS table_name, CAST(MIN({c}) AS VARCHAR) AS min_date, CAST(MAX({c}) AS VARCHAR) AS max_date,
                   COUNT(*) AS rows FROM {_SQL_NAMES[n]}"""
        for n, c in _COVERED.items()
    ),
)
def a27(t):
    return overview.date_coverage({n: (t.all[n], c) for n, c in _COVERED.items()})


@query(
    "a27b_source_profile",
    """SELECT 'lineitem' AS provider, CAST(MIN("date") AS VARCHAR) AS first_observation,
              CAST(MAX("date") AS VARCHAR) AS last_observation, COUNT(DISTINCT "date") AS rows FROM app_fx""",
)
def a27b(t):
    return source_profile(t.fx_daily, "lineitem")


_SNAP_SQL = """SELECT user_id, CAST(observation_date AS VARCHAR) AS observation_date, recency_days, transactions_90d,
    {extra} total_volume_90d, failed_ratio_90d, target_repeat_30d FROM snaps"""


@query("m6_snapshot_features", _SNAP_SQL.format(extra=""))
def m6(t):
    return snapshots.snapshot_features(t.snapshots)


@query("m7_build_snapshots", _SNAP_SQL.format(extra="transactions_all,"))
def m7(t):
    return t.snapshots

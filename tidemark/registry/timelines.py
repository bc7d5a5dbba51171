"""Values in force, intervals, sessions and trailing sums."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.numeric import count_where, exact_sum, pct
from tidemark.operators import lifecycle, timeline
from tidemark.plans import increments
from tidemark.plans.staging import shared_dir
from tidemark.registry import base
from tidemark.registry.base import money, query
from tidemark.streaming import milestones

#: Half of the transactions are in one pair.
_PAIR = "CASE WHEN transaction_id % 10 < 5 THEN 'N' WHEN transaction_id % 10 < 8 THEN 'A' ELSE 'R' END"


def _priced(t):
    """Transactions with a currency pair, and the daily rates by instant."""
    made = t.tx.select(
        "transaction_id", "user_id", "transaction_timestamp", "transaction_type", "transaction_status", "transaction_amount_krw",
        F.expr(_PAIR).alias("pair"),
    )
    rates = t.fx_daily.select("pair", F.col("date").cast("timestamp_ntz").alias("rate_at"), F.col("close").alias("rate"))
    return made, rates


_PRICED = f"""(SELECT *, {_PAIR} AS pair FROM app_tx) t
    ASOF LEFT JOIN (SELECT pair, CAST("date" AS TIMESTAMP) AS rate_at, close AS rate FROM app_fx) r
    ON t.pair = r.pair AND t.transaction_timestamp >= r.rate_at"""


@query(
    "j14_asof_rate",
    f"""SELECT transaction_id, t.pair, CAST(CAST(rate_at AS DATE) AS VARCHAR) AS rate_date, rate FROM {_PRICED}""",
)
def j14(t):
    """The daily rate in force at each transaction."""
    made, rates = _priced(t)
    found = timeline.asof_join(made, rates, ["pair"], "transaction_timestamp", "rate_at", ["rate"], matched_at="rate_date")
    return found.select("transaction_id", "pair", F.col("rate_date").cast("date").alias("rate_date"), "rate")


@query(
    "j15_asof_tolerance",
    """SELECT event_id, user_id, event_name, CASE WHEN "timestamp" >= event_timestamp - INTERVAL 3 HOUR THEN "timestamp" END AS rate_at,
              CASE WHEN "timestamp" >= event_timestamp - INTERVAL 3 HOUR THEN close_rate END AS close_rate,
              CASE WHEN "timestamp" >= event_timestamp - INTERVAL 3 HOUR THEN market_regime END AS market_regime
       FROM app_events e ASOF LEFT JOIN app_rates r ON e.event_name = r.currency_pair AND e.event_timestamp > r."timestamp" """,
)
def j15(t):
    """The rate and regime of the last hour before each event, three hours old at most."""
    rates = t.rates.withColumnRenamed("currency_pair", "event_name")
    found = timeline.asof_join(
        t.events, rates, ["event_name"], "event_timestamp", "timestamp", ["close_rate", "market_regime"],
        tolerance=timedelta(hours=3), strict=True, matched_at="rate_at",
    )
    return found.select("event_id", "user_id", "event_name", "rate_at", "close_rate", "market_regime")


@query(
    "a28_behavior_by_rate_move",
    f"""SELECT rate_move, COUNT(*) AS transaction_attempts, SUM(CAST(transaction_status = 'completed' AS INTEGER)) AS successful_transactions,
               {base.pct("SUM(CAST(transaction_status = 'completed' AS INTEGER))", "COUNT(*)")} AS success_rate,
               {money("transaction_amount_krw")} AS attempted_volume_krw
        FROM (SELECT *, CASE WHEN rate IS NULL OR prior IS NULL THEN 'unknown' WHEN rate > prior THEN 'up' WHEN rate < prior THEN 'down'
                             ELSE 'flat' END AS rate_move
              FROM (SELECT *, {_PAIR} AS pair FROM app_tx) t
              ASOF LEFT JOIN (SELECT pair, CAST("date" AS TIMESTAMP) AS rate_at, close AS rate,
                                     lag(close) OVER (PARTITION BY pair ORDER BY "date") AS prior FROM app_fx) r
              ON t.pair = r.pair AND t.transaction_timestamp >= r.rate_at)
        WHERE transaction_type = 'exchange' GROUP BY rate_move""",
)
def a28(t):
    """Exchange behaviour by the rate's last daily move, known at the time of the attempt."""
    made, rates = _priced(t)
    moves = rates.withColumn("prior", F.lag("rate").over(W.partitionBy("pair").orderBy("rate_at")))
    found = timeline.asof_join(lifecycle.exchanges(made), moves, ["pair"], "transaction_timestamp", "rate_at", ["rate", "prior"])
    move = F.when(F.col("rate").isNull() | F.col("prior").isNull(), "unknown").when(F.col("rate") > F.col("prior"), "up")
    move = move.when(F.col("rate") < F.col("prior"), "down").otherwise("flat")
    done = F.col("transaction_status") == lifecycle.COMPLETED
    return found.groupBy(move.alias("rate_move")).agg(
        F.count(F.lit(1)).alias("transaction_attempts"),
        count_where(done).alias("successful_transactions"),
        pct(count_where(done), F.count(F.lit(1))).alias("success_rate"),
        exact_sum("transaction_amount_krw").alias("attempted_volume_krw"),
    )


@query(
    "j16_interval_pairs",
    """SELECT w.transaction_id AS opening_id, COUNT(*) AS later_attempts, MIN(t.transaction_id) AS least_later_id
       FROM wins w JOIN tries t ON t.user_id = w.user_id AND t.transaction_timestamp > w.transaction_timestamp
            AND t.transaction_timestamp <= w.transaction_timestamp + INTERVAL 30 DAY
       GROUP BY w.transaction_id""",
)
def j16(t):
    """Attempts in the 30 days after each completed exchange: a user's intervals overlap."""
    opened = lifecycle.successful(t.tx).select(
        "user_id", F.col("transaction_id").alias("opening_id"), F.col("transaction_timestamp").alias("opened"),
        (F.col("transaction_timestamp") + F.make_dt_interval(F.lit(30))).alias("closed"),
    )
    tries = lifecycle.exchanges(t.tx).select("user_id", "transaction_id", "transaction_timestamp")
    pairs = timeline.interval_join(tries, opened, ["user_id"], "transaction_timestamp", "opened", "closed", closed="right")
    after = pairs.where(F.col("transaction_timestamp") > F.col("opened"))
    return after.groupBy("opening_id").agg(F.count(F.lit(1)).alias("later_attempts"), F.min("transaction_id").alias("least_later_id"))


_STRETCHES = """
    SELECT currency_pair, market_regime, MIN("timestamp") - INTERVAL 2 HOUR AS opened, MAX("timestamp") + INTERVAL 3 HOUR AS closed
    FROM (SELECT *, SUM(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY currency_pair ORDER BY "timestamp") AS run
          FROM (SELECT *, COALESCE(market_regime = lag(market_regime) OVER w, FALSE) AS same FROM app_rates
                WINDOW w AS (PARTITION BY currency_pair ORDER BY "timestamp")))
    GROUP BY currency_pair, market_regime, run"""


@query(
    "j17_regime_stretches",
    f"""SELECT event_name, market_regime, COUNT(*) AS pairs, COUNT(DISTINCT event_id) AS events
        FROM app_events e JOIN ({_STRETCHES}) s ON s.currency_pair = e.event_name
             AND e.event_timestamp >= s.opened AND e.event_timestamp < s.closed
        GROUP BY event_name, market_regime""",
)
def j17(t):
    """Events within two hours of each stretch of hours in one regime; padded stretches overlap."""
    order = W.partitionBy("currency_pair").orderBy("timestamp")
    same = F.coalesce(F.col("market_regime") == F.lag("market_regime").over(order), F.lit(False))
    runs = t.rates.withColumn("starts", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("starts").over(order))
    stretches = runs.groupBy(F.col("currency_pair").alias("event_name"), "market_regime", "run").agg(
        (F.min("timestamp") - F.lit(timedelta(hours=2))).alias("opened"), (F.max("timestamp") + F.lit(timedelta(hours=3))).alias("closed")
    )
    met = timeline.interval_join(t.events, stretches, ["event_name"], "event_timestamp", "opened", "closed")
    return met.groupBy("event_name", "market_regime").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("event_id").alias("events"))


@query(
    "w13_sessions",
    """SELECT user_id, session_number, MIN(event_timestamp) AS session_start, MAX(event_timestamp) AS session_end, COUNT(*) AS events
       FROM (SELECT *, SUM(opens) OVER (PARTITION BY user_id ORDER BY event_timestamp) AS session_number
             FROM (SELECT *, CASE WHEN event_timestamp <= lag(event_timestamp) OVER (PARTITION BY user_id ORDER BY event_timestamp)
                                       + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS opens FROM app_events))
       GROUP BY user_id, session_number""",
)
def w13(t):
    """Runs of a user's events at most twelve hours apart."""
    return timeline.sessions(t.events, timedelta(hours=12))


@query(
    "w14_trailing_sums",
    """SELECT transaction_id, user_id, CAST(SUM(CAST(transaction_amount_krw AS DECIMAL(28,8))) OVER w AS DOUBLE) AS volume_90d,
              COUNT(transaction_amount_krw) OVER w AS transactions_90d
       FROM tries WINDOW w AS (PARTITION BY user_id ORDER BY transaction_timestamp
                               RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND CURRENT ROW)""",
)
def w14(t):
    """Volume and number of a user's attempts in the 90 days up to each."""
    tries = lifecycle.exchanges(t.tx).select("transaction_id", "user_id", "transaction_timestamp", "transaction_amount_krw")
    found = timeline.trailing_sums(
        tries, ["user_id"], "transaction_timestamp", "transaction_amount_krw", timedelta(days=90), "volume_90d", "transactions_90d"
    )
    return found.select("transaction_id", "user_id", "volume_90d", "transactions_90d")


@query("m9_streamed_lifecycle", "SELECT * FROM mart")
def m9(t):
    """The mart from streams over files of its three sources, a few files in each batch, started twice on one checkpoint."""
    folder = f"{shared_dir(t.spark)}/milestones-{uuid.uuid4().hex}"
    sources = {"users": t.users, "tx": t.tx, "events": t.events}
    opened = []
    for name, df in sources.items():
        df.repartition(6, F.xxhash64(*df.columns)).write.parquet(f"{folder}/{name}")
        opened.append(t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 3).parquet(f"{folder}/{name}"))
    for _ in range(2):
        stream = milestones.milestone_stream(*opened)
        milestones.start(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return milestones.merged(t.spark, f"{folder}/out")


@query("s13_incremental_mart", "SELECT * FROM mart")
def s13(t):
    """The mart kept up by three increments of whole months."""
    store = f"{shared_dir(t.spark)}/success-{uuid.uuid4().hex}"
    year = F.year("transaction_timestamp")
    for part in (year < 1997, (year >= 1997) & (year < 1999), year >= 1999):
        increments.add_days(store, t.tx.where(part), "month")
    return increments.user_lifecycle(store, t.users, t.events)

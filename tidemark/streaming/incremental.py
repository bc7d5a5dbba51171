"""The batch operators whose work can go on as rows arrive, with state bounded by a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import count_where, exact_avg, pct, round_half_up
from tidemark.operators.cleaning import EVENT_KEY
from tidemark.operators.lifecycle import COMPLETED, exchanges
from tidemark.operators.regimes import REGIME


def watermarked(stream: DataFrame, column: str, delay: str) -> DataFrame:
    """Event time for the state limits; watermarks need TIMESTAMP, so an NTZ column is read in the session zone."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def dedupe_stream(
    events: DataFrame, keys: Sequence[str] = EVENT_KEY, at: str = "event_timestamp", delay: str = "2 hours"
) -> DataFrame:
    """One row per business key, the first to arrive; a key is forgotten ``delay`` after its event time."""
    return watermarked(events, at, delay).dropDuplicatesWithinWatermark(list(keys))


def regime_behavior_stream(tx: DataFrame, window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Attempts, successes, success rate and mean amount per regime and event-time window."""
    done = F.col("transaction_status") == COMPLETED
    timed = watermarked(exchanges(tx), "transaction_timestamp", delay)
    return timed.groupBy(F.window("transaction_timestamp", window).alias("w"), REGIME).agg(
        F.count(F.lit(1)).alias("transaction_attempts"),
        count_where(done).alias("successful_transactions"),
        pct(count_where(done), F.count(F.lit(1))).alias("success_rate"),
        round_half_up(exact_avg("transaction_amount_krw"), 0).alias("avg_transaction_amount_krw"),
    )


def flag_stream(events: DataFrame, name: str, at: str = "event_timestamp", delay: str = "30 days") -> DataFrame:
    """Users as they first show an event; a user may appear again once ``delay`` has passed, so upsert the sink."""
    shown = watermarked(events.where(F.col("event_name") == name), at, delay)
    return shown.dropDuplicatesWithinWatermark(["user_id"]).select("user_id", at)

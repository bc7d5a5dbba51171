"""Value segments of users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.labels import recode
from tidemark.functions.numeric import exact_avg, exact_sum, pct, round_half_up
from tidemark.operators.lifecycle import successful, valid_users
from tidemark.operators.ranking import ntile_scalable

# Fixed segment labels.
QUARTILE_LABELS = {1: "Q1 lowest volume", 2: "Q2", 3: "Q3", 4: "Q4 highest volume"}


def user_value(mart: DataFrame, tx: DataFrame) -> DataFrame:
    """Count, volume and fees of completed exchanges for valid users; facts are summed before the join."""
    totals = (
        successful(tx)
        .groupBy("user_id")
        .agg(
            F.count("transaction_id").alias("successful_transactions"),
            exact_sum("transaction_amount_krw").alias("total_volume_krw"),
            exact_sum("fee_amount_krw").alias("total_fee_krw"),
        )
    )
    who = valid_users(mart).select("user_id", "acquisition_channel", "target_rate_user_flag", "rate_alert_user_flag")
    return who.join(totals, "user_id")


def value_segments(mart: DataFrame, tx: DataFrame, n: int = 4, ranges: int | None = None) -> DataFrame:
    """Profile of users by volume n-tile; ties in volume are ordered by user."""
    tiles = ntile_scalable(user_value(mart, tx), "total_volume_krw", "user_id", n, "value_quartile", ranges)
    label = recode("value_quartile", QUARTILE_LABELS) if n == 4 else F.concat(F.lit("Q"), F.col("value_quartile"))
    profile = tiles.groupBy("value_quartile").agg(
        F.count(F.lit(1)).alias("users"),
        round_half_up(F.avg("successful_transactions"), 2).alias("avg_successful_transactions"),
        round_half_up(exact_avg("total_volume_krw"), 0).alias("avg_total_volume_krw"),
        round_half_up(exact_avg("total_fee_krw"), 0).alias("avg_total_fee_krw"),
        pct(F.sum("target_rate_user_flag"), F.count("target_rate_user_flag")).alias("target_rate_adoption_rate"),
        pct(F.sum("rate_alert_user_flag"), F.count("rate_alert_user_flag")).alias("rate_alert_adoption_rate"),
    )
    columns = [c for c in profile.columns if c != "value_quartile"]
    return profile.orderBy("value_quartile").select(label.alias("value_segment"), *columns)

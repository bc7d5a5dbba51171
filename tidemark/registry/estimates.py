"""Estimates from mergeable sketches, each held against the exact answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import lifecycle, sketches
from tidemark.plans.staging import staged
from tidemark.registry.base import query

_CHANNELLED = "tries t JOIN app_users u ON u.user_id = t.user_id"


def _channelled(t):
    facts = lifecycle.exchanges(t.tx).select("user_id", "transaction_timestamp", "transaction_amount_krw")
    return facts.join(t.users.select("user_id", "acquisition_channel"), "user_id")


def _daily(t):
    """Sketches stored per day and channel."""
    days = _channelled(t).withColumn("day", F.col("transaction_timestamp").cast("date"))
    return staged(sketches.sketch_states(days, ["acquisition_channel", "day"]), "sketches-daily")


@query(
    "g13_sketched_channels",
    f"""SELECT acquisition_channel, COUNT(*) AS attempts, COUNT(DISTINCT t.user_id) AS users, TRUE AS hll_within, TRUE AS theta_within,
               TRUE AS median_within, TRUE AS sizes_within FROM {_CHANNELLED} GROUP BY acquisition_channel""",
)
def g13(t):
    """Users and median amount of each channel from daily sketches, and whether they keep their bounds."""
    merged = staged(sketches.merged_states(_daily(t), ["acquisition_channel"]), "sketches-merged")
    median = merged.select("acquisition_channel", sketches.quantile(0.5).alias("median"))
    amount = F.col("transaction_amount_krw")
    exact = (
        _channelled(t)
        .join(F.broadcast(median), "acquisition_channel")
        .groupBy("acquisition_channel")
        .agg(
            F.count_distinct("user_id").alias("users"),
            F.avg((amount < F.col("median")).cast("int")).alias("below"),
            F.avg((amount <= F.col("median")).cast("int")).alias("upto"),
        )
    )
    users, size = F.col("users"), F.octet_length
    sizes = (size("users_hll") <= sketches.HLL_BYTES) & (size("users_theta") <= sketches.THETA_BYTES) & (size("value_kll") <= sketches.KLL_BYTES)
    return merged.join(exact, "acquisition_channel").select(
        "acquisition_channel",
        F.col("rows").alias("attempts"),
        "users",
        (F.abs(sketches.users_estimate() - users) <= sketches.HLL_ERROR * users).alias("hll_within"),
        (F.abs(sketches.users_estimate("users_theta") - users) <= sketches.THETA_ERROR * users).alias("theta_within"),
        F.lit(0.5).between(F.col("below") - sketches.RANK_ERROR, F.col("upto") + sketches.RANK_ERROR).alias("median_within"),
        sizes.alias("sizes_within"),
    )


@query(
    "g14_cohort_overlap",
    f"""SELECT acquisition_channel, COUNT(*) FILTER (WHERE a AND b) AS users_of_both, COUNT(*) AS users_of_either, TRUE AS within
        FROM (SELECT acquisition_channel, t.user_id, bool_or(year(transaction_timestamp) = 1997) AS a, bool_or(year(transaction_timestamp) = 1998) AS b
              FROM {_CHANNELLED} WHERE year(transaction_timestamp) IN (1997, 1998) GROUP BY ALL)
        GROUP BY acquisition_channel HAVING bool_or(a) AND bool_or(b)""",
)
def g14(t):
    """Users of a channel who were active in two years, by intersecting sketches merged from the days of each."""
    yearly = sketches.merged_states(_daily(t).withColumn("year", F.year("day")), ["acquisition_channel", "year"])
    found = sketches.shared_users(staged(yearly, "sketches-yearly"), ["acquisition_channel"], "year", 1997, 1998)
    year = F.year("transaction_timestamp")
    active = _channelled(t).where(year.isin(1997, 1998)).groupBy("acquisition_channel", "user_id")
    active = active.agg(F.max((year == 1997).cast("int")).alias("a"), F.max((year == 1998).cast("int")).alias("b"))
    exact = active.groupBy("acquisition_channel").agg(F.sum(F.col("a") * F.col("b")).cast("long").alias("users_of_both"), F.count(F.lit(1)).alias("users_of_either"))
    bound = sketches.THETA_ERROR * F.col("users_of_either")
    return found.join(exact, "acquisition_channel").select(
        "acquisition_channel", "users_of_both", "users_of_either", (F.abs(F.col("shared") - F.col("users_of_both")) <= bound).alias("within")
    )

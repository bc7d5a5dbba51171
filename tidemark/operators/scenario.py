"""Campaign scenario grid over audience aggregates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import exact_sum
from tidemark.operators.ranking import exact_quantiles
from tidemark.plans.staging import staged

# Fixed assumptions and note.
UPLIFTS = {"low": 0.02, "base": 0.05, "high": 0.08}
FEE_RATES = {"low": 0.00015, "base": 0.00025, "high": 0.00035}
NOTE = "Directional scenario only; not forecast revenue or causal impact."


def audience_totals(audience: DataFrame) -> DataFrame:
    """Size, expected repeat users and median positive volume of an audience, as one row.

    Runs jobs at once: the two columns needed are written and read for the median and for the sums.
    """
    audience = staged(audience.select("total_volume_90d", "repeat_probability"), "audience")
    median = exact_quantiles(audience.where("total_volume_90d > 0"), "total_volume_90d", [0.5])[0]
    return audience.agg(
        F.count(F.lit(1)).alias("audience_users"),
        exact_sum("repeat_probability").alias("baseline_expected_repeat_users"),
        F.lit(median).cast("double").alias("median_recent_volume_proxy_krw"),
    )


def scenario_grid(
    totals: DataFrame, uplifts: Mapping[str, float] = UPLIFTS, fees: Mapping[str, float] = FEE_RATES
) -> DataFrame:
    """Every uplift with every fee rate for each totals row: the literal grid is expanded in place."""
    cells = [
        F.struct(
            F.lit(u).alias("uplift_scenario"),
            F.lit(uplift).alias("absolute_uplift_assumption"),
            F.lit(f).alias("fee_proxy_scenario"),
            F.lit(fee).alias("fee_proxy_rate_assumption"),
        )
        for u, uplift in uplifts.items()
        for f, fee in fees.items()
    ]
    grid = totals.select("*", F.inline(F.array(*cells)))
    users = F.col("audience_users").cast("double") * F.col("absolute_uplift_assumption")
    volume = F.col("incremental_repeat_users") * F.col("median_recent_volume_proxy_krw")
    value = F.col("incremental_volume_proxy_krw") * F.col("fee_proxy_rate_assumption")
    full = (
        grid.withColumn("incremental_repeat_users", users)
        .withColumn("incremental_volume_proxy_krw", volume)
        .withColumn("value_impact_proxy_krw", value)
        .withColumn("assumption_note", F.lit(NOTE))
    )
    return full.select(
        "audience_users",
        "baseline_expected_repeat_users",
        "uplift_scenario",
        "absolute_uplift_assumption",
        "incremental_repeat_users",
        "median_recent_volume_proxy_krw",
        "incremental_volume_proxy_krw",
        "fee_proxy_scenario",
        "fee_proxy_rate_assumption",
        "value_impact_proxy_krw",
        "assumption_note",
    )


def base_scenario(grid: DataFrame) -> DataFrame:
    return grid.where((F.col("uplift_scenario") == "base") & (F.col("fee_proxy_scenario") == "base"))

"""Experiment assignment and two-proportion evaluation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import ratio
from tidemark.functions.stats import two_sided_p

CONTROL, TREATMENT = "control", "treatment"
HASH_SPACE = 2**32
# Fixed thresholds.
VARIANCE_FLOOR = 1e-12
CI_FACTOR = 1.96
ALPHA = 0.05
PRACTICAL_THRESHOLDS = {"primary": 0.02}
OTHER_PRACTICAL_THRESHOLD = 0.01
HIGH_VALUE_LIFETIME = 10_000_000
METRIC_ROLES = {
    "feature_adoption_7d": "primary",
    "first_exchange_14d": "secondary",
    "guardrail_event_30d": "guardrail",
}


def assign_variant(
    df: DataFrame,
    unit: str,
    salt: str,
    weights: Mapping[str, float] | None = None,
    out: str = "variant",
) -> DataFrame:
    """Variant from a hash of salt and unit: the same for a unit in every run, engine and partitioning."""
    weights = weights or {CONTROL: 1.0, TREATMENT: 1.0}
    digest = F.md5(F.concat(F.lit(f"{salt}:"), F.col(unit).cast("string")))
    point = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    total = sum(weights.values())
    names = list(weights)
    variant: Column | None = None
    reached = 0.0
    for name in names[:-1]:
        reached += weights[name]
        below = point < F.lit(int(HASH_SPACE * reached / total))
        variant = F.when(below, name) if variant is None else variant.when(below, name)
    last = F.lit(names[-1])
    return df.withColumn(out, last if variant is None else variant.otherwise(last))


def lifetime_value_segment(volume: str = "successful_transaction_volume") -> Column:
    return F.when(F.col(volume) >= HIGH_VALUE_LIFETIME, "High value").otherwise("Standard value")


def _arms(metrics: Sequence[str], variant: str) -> list[Column]:
    """Rows and successes of both arms for every metric, as aggregates of one pass."""
    columns = []
    for m in metrics:
        for arm in (CONTROL, TREATMENT):
            held = F.when(F.col(variant) == arm, F.col(m))
            columns.append(F.count(held).alias(f"{m}__{arm}_n"))
            columns.append(F.sum(held).alias(f"{m}__{arm}_hits"))
    return columns


def two_proportions(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Rates, uplift, pooled z, unpooled 95 % interval and p from ``control_n/_rate, treatment_n/_rate``.

    Column arithmetic on aggregated rows; only the normal tail is a (vectorised) function.
    """
    cn, tn = F.col("control_n").cast("double"), F.col("treatment_n").cast("double")
    cr, tr = F.col("control_rate"), F.col("treatment_rate")
    pooled = ratio(cr * cn + tr * tn, cn + tn)
    inverse = ratio(F.lit(1.0), cn) + ratio(F.lit(1.0), tn)
    pooled_se = F.sqrt(F.greatest(pooled * (F.lit(1.0) - pooled) * inverse, F.lit(VARIANCE_FLOOR)))
    own_variance = ratio(cr * (F.lit(1.0) - cr), cn) + ratio(tr * (F.lit(1.0) - tr), tn)
    own_se = F.sqrt(F.greatest(own_variance, F.lit(VARIANCE_FLOOR)))
    uplift = F.col("absolute_uplift")
    tested = (
        df.withColumn("absolute_uplift", tr - cr)
        .withColumn("relative_uplift", F.when(cr > 0, ratio(uplift, cr)))
        .withColumn("ci_95_low", uplift - CI_FACTOR * own_se)
        .withColumn("ci_95_high", uplift + CI_FACTOR * own_se)
        .withColumn("z_statistic", ratio(uplift, pooled_se))
        .withColumn("p_value", two_sided_p(F.col("z_statistic")))
    )
    return tested.withColumn("statistically_significant_5pct", F.col("p_value") < ALPHA)


def _long(counted: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    rows = []
    for m in metrics:
        c_n, t_n = F.col(f"{m}__{CONTROL}_n"), F.col(f"{m}__{TREATMENT}_n")
        rows.append(
            F.struct(
                F.lit(m).alias("metric"),
                c_n.alias("control_n"),
                t_n.alias("treatment_n"),
                ratio(F.col(f"{m}__{CONTROL}_hits"), c_n).alias("control_rate"),
                ratio(F.col(f"{m}__{TREATMENT}_hits"), t_n).alias("treatment_rate"),
            )
        )
    return counted.select(*keys, F.inline(F.array(*rows)))


def ab_test(df: DataFrame, metrics: Sequence[str], variant: str = "variant") -> DataFrame:
    """One tested row per metric; both arms of all metrics are counted in one pass."""
    return two_proportions(_long(df.agg(*_arms(metrics, variant)), [], metrics))


def ab_results(
    df: DataFrame, roles: Mapping[str, str] = METRIC_ROLES, source: str = "observed", variant: str = "variant"
) -> DataFrame:
    """Tested metrics with their role and whether the uplift is large enough to matter."""
    tested = ab_test(df, list(roles), variant)
    role = F.create_map(*[F.lit(x) for pair in roles.items() for x in pair])[F.col("metric")]
    known = F.lit(None).cast("double")
    for name, value in PRACTICAL_THRESHOLDS.items():
        known = F.when(F.col("metric_role") == name, F.lit(value)).otherwise(known)
    needed = F.coalesce(known, F.lit(OTHER_PRACTICAL_THRESHOLD))
    return (
        tested.withColumn("metric_role", role)
        .withColumn("practically_significant", F.abs(F.col("absolute_uplift")) >= needed)
        .withColumn("data_source", F.lit(source))
    )


def ab_segments(
    df: DataFrame,
    dims: Sequence[str] = ("acquisition_channel", "value_segment"),
    metric: str = "feature_adoption_7d",
    min_n: int = 100,
    source: str = "observed",
    variant: str = "variant",
) -> DataFrame:
    """The same test inside each value of each dimension; segments with a small arm are left out."""
    kinds = [
        F.struct(F.lit(d).alias("segment_type"), F.col(d).cast("string").alias("segment")) for d in dims
    ]
    rows = df.select(variant, metric, F.inline(F.array(*kinds))).where("segment IS NOT NULL")
    keys = ["segment_type", "segment"]
    counted = rows.groupBy(*keys).agg(*_arms([metric], variant))
    long = _long(counted, keys, [metric]).where(F.least("control_n", "treatment_n") >= min_n)
    return two_proportions(long).withColumn("data_source", F.lit(source)).orderBy(F.desc("absolute_uplift"))

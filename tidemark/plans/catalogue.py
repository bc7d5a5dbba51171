"""The extract catalogue: output name to query, and the batch that writes them all."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tidemark.operators import funnel, regimes, repeat, retention, snapshots, value
from tidemark.operators.lifecycle import user_lifecycle
from tidemark.plans.staging import staged
from tidemark.sources.extracts import write_extract


@dataclass(frozen=True)
class Inputs:
    """Frames the extracts read."""

    mart: DataFrame
    tx: DataFrame
    repeat: DataFrame
    rates: DataFrame
    tickets: DataFrame
    snapshots: DataFrame


def prepare(
    users: DataFrame, tx: DataFrame, events: DataFrame, rates: DataFrame, tickets: DataFrame, snapshot_rows: DataFrame
) -> Inputs:
    """Stage the mart and the repeat flags once, since most extracts read them."""
    mart = staged(user_lifecycle(users, tx, events), "mart")
    return Inputs(mart, tx, staged(repeat.repeat_within(tx), "repeat"), rates, tickets, snapshot_rows)


EXPORTS: dict[str, Callable[[Inputs], DataFrame]] = {
    "product_funnel": lambda i: funnel.funnel(i.mart),
    "funnel_by_acquisition_channel": lambda i: funnel.funnel(i.mart, by=["acquisition_channel"]),
    "d30_repeat_by_channel": lambda i: repeat.repeat_rate(i.mart, i.repeat),
    "feature_adoption": lambda i: funnel.feature_adoption(i.mart),
    "feature_retention_comparison": lambda i: repeat.feature_retention(i.mart, i.repeat),
    "feature_combination_retention": lambda i: repeat.feature_combo(i.mart, i.repeat),
    "fx_regime_behavior": lambda i: regimes.regime_behavior(i.tx),
    "fx_regime_normalized_activity": lambda i: regimes.regime_activity(i.tx, i.rates),
    "failure_reason_by_regime": lambda i: regimes.failure_share(i.tx),
    "monthly_product_trend": lambda i: funnel.monthly_trend(i.mart),
    "cohort_retention": lambda i: retention.cohort_retention(i.tx, i.mart, 6),
    "customer_value_segmentation": lambda i: value.value_segments(i.mart, i.tx),
    "support_ticket_impact": lambda i: repeat.support_impact(i.mart, i.repeat, i.tickets),
    "modeling_table_check": lambda i: snapshots.snapshot_profile(i.snapshots),
    "user_lifecycle_summary": lambda i: funnel.lifecycle_summary(i.mart),
}


def _write(made: Mapping[str, Callable[[], DataFrame]], directory: str, overwrite: bool, fmt: str) -> dict[str, float | None]:
    took: dict[str, float | None] = {}
    for name, make in made.items():
        start = time.perf_counter()
        wrote = write_extract(make(), f"{directory.rstrip('/')}/{name}", overwrite, fmt)
        took[name] = time.perf_counter() - start if wrote else None
    return took


def export_all(
    inputs: Inputs,
    directory: str,
    overwrite: bool = False,
    fmt: str = "csv",
    exports: Mapping[str, Callable[[Inputs], DataFrame]] = EXPORTS,
) -> dict[str, float | None]:
    """Write every extract of the catalogue; seconds per extract, None for one left as it was.

    ``prepare`` makes the inputs, with the shared ones written once.
    """
    return _write({name: (lambda b=build: b(inputs)) for name, build in exports.items()}, directory, overwrite, fmt)


def export_frames(frames: Mapping[str, DataFrame], directory: str, overwrite: bool = False, fmt: str = "csv") -> dict[str, float | None]:
    """Write frames that are at hand, as the flows of ``model_flows`` give them, like entries of the catalogue."""
    return _write({name: (lambda d=df: d) for name, df in frames.items()}, directory, overwrite, fmt)

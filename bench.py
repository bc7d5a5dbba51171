"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query is built and run from the raw tables (nothing is shared between them).  One small untimed query
warms the session; every timed query then runs once and its whole result is written to a no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark import registry  # noqa: E402
from tidemark.plans.staging import release_staged  # noqa: E402
from tidemark.session import build_session  # noqa: E402

HEADLINE = (
    "m1_clean_events",
    "m2_user_lifecycle",
    "m4_repeat_within",
    "m7_build_snapshots",
    "a1_funnel",
    "a2_funnel_by_channel",
    "a7_d30_by_channel",
    "a9_feature_retention",
    "a10_feature_combo",
    "a11_regime_behavior",
    "a12_regime_activity",
    "a13_failure_share",
    "a14_cohort_retention",
    "a15_value_segments",
    "a16_support_impact",
    "a17_snapshot_profile",
    "q15_issue_report",
    "t2_targeting_b",
    "t9_ab_results",
    "g8_exact_quantiles",
    "w3_ntile",
    "l11_roc_auc",
    "l25_fx_features",
)


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "tidemark-bench",
        f"local[{cpus}]",
        spark__ui__enabled="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "8g"),
        spark__sql__shuffle__partitions=cpus,
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    wanted = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    queries["a1_funnel"](spark, directory).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in wanted:
        started = time.perf_counter()
        queries[name](spark, directory).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    release_staged(spark)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(directory.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

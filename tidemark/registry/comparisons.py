"""Grouping sets, reconciled extracts and steps in strict order."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import cubes, lifecycle, reconcile, steps
from tidemark.registry import base
from tidemark.registry.base import money, query

_SETS = [["acquisition_channel", "regime", "month"], ["acquisition_channel", "regime"], ["acquisition_channel"], ["month"], []]


def _label(*dims: str) -> str:
    parts = ", ".join(f"CASE WHEN GROUPING({d}) = 0 THEN '{d}' END" for d in dims)
    return f"CASE WHEN {' + '.join(f'GROUPING({d})' for d in dims)} = {len(dims)} THEN 'total' ELSE concat_ws(',', {parts}) END AS set_name"


@query(
    "g15_grouping_sets",
    f"""SELECT {_label("acquisition_channel", "regime", "month")}, acquisition_channel, regime, month, COUNT(DISTINCT user_id) AS users,
               COUNT(*) AS "rows", {money("transaction_amount_krw")} AS transaction_amount_krw
        FROM (SELECT w.user_id, transaction_amount_krw, acquisition_channel, market_regime_at_transaction AS regime,
                     strftime(transaction_timestamp, '%Y-%m') AS month FROM tries w LEFT JOIN app_users u ON u.user_id = w.user_id)
        GROUP BY GROUPING SETS ((acquisition_channel, regime, month), (acquisition_channel, regime), (acquisition_channel), (month), ())""",
)
def g15(t):
    """Users, attempts and volume by channel, regime and month on five levels."""
    tries = lifecycle.exchanges(t.tx).join(t.users.select("user_id", "acquisition_channel"), "user_id", "left")
    flat = tries.select(
        "user_id", "transaction_amount_krw", "acquisition_channel", F.col("market_regime_at_transaction").alias("regime"),
        F.date_format("transaction_timestamp", "yyyy-MM").alias("month"),
    )
    return cubes.distinct_by_sets(flat, _SETS, sums=["transaction_amount_krw"])


@query(
    "g16_cube_users",
    f"""SELECT {_label("transaction_type", "order_type", "failure_reason")}, transaction_type, order_type, failure_reason,
               COUNT(DISTINCT user_id) AS users, COUNT(*) AS attempts
        FROM app_tx GROUP BY CUBE (transaction_type, order_type, failure_reason)""",
)
def g16(t):
    """Users and attempts of every combination; most failure reasons are null, which is a value of its own."""
    return cubes.distinct_by_sets(t.tx, cubes.cube_sets(["transaction_type", "order_type", "failure_reason"]), rows="attempts")


_EXTRACT = "transaction_id, user_id, transaction_status, transaction_amount_krw, failure_reason"
#: A later extract of the transactions: some rows gone, some corrected, some twice, some new.
_LATER = f"""
    SELECT transaction_id, user_id, CASE WHEN transaction_id % 110 = 0 THEN 'reversed' ELSE transaction_status END AS transaction_status,
           CASE WHEN transaction_id % 70 = 0 THEN transaction_amount_krw + 1 ELSE transaction_amount_krw END AS transaction_amount_krw,
           CASE WHEN transaction_id % 130 <> 0 THEN failure_reason END AS failure_reason
    FROM app_tx WHERE transaction_id % 50 <> 0
    UNION ALL SELECT {_EXTRACT} FROM app_tx WHERE transaction_id % 90 = 0
    UNION ALL SELECT transaction_id + 1000000000000, user_id, 'completed', transaction_amount_krw, NULL FROM app_tx WHERE transaction_id % 80 = 0"""


def _extracts(t) -> tuple[DataFrame, DataFrame]:
    old = t.tx.select(*_EXTRACT.split(", "))
    return old, t.tx.sparkSession.sql(_LATER.replace("app_tx", "{app_tx}"), app_tx=t.tx)


_BOTH = f"""
    old_rows AS MATERIALIZED (SELECT {_EXTRACT} FROM app_tx), new_rows AS MATERIALIZED ({_LATER}),
    gone AS MATERIALIZED (SELECT * FROM old_rows EXCEPT ALL SELECT * FROM new_rows),
    come AS MATERIALIZED (SELECT * FROM new_rows EXCEPT ALL SELECT * FROM old_rows)"""


@query(
    "u4_surplus_rows",
    f"""WITH {_BOTH}
        SELECT *, 'left' AS surplus_side, COUNT(*) AS surplus_rows FROM gone GROUP BY ALL
        UNION ALL SELECT *, 'right' AS surplus_side, COUNT(*) AS surplus_rows FROM come GROUP BY ALL""",
)
def u4(t):
    """Rows that one of two extracts has more often than the other."""
    return reconcile.surplus(*_extracts(t))


_VALUES = ("user_id", "transaction_status", "transaction_amount_krw", "failure_reason")


@query(
    "u5_key_changes",
    f"""WITH {_BOTH},
        l AS (SELECT transaction_id, COUNT(*) AS n, COUNT(DISTINCT x) AS d, {", ".join(f"ANY_VALUE(x.{c}) AS {c}" for c in _VALUES)}
              FROM (SELECT transaction_id, struct_pack({", ".join(f"{c} := {c}" for c in _VALUES)}) AS x FROM gone) GROUP BY 1),
        r AS (SELECT transaction_id, COUNT(*) AS n, COUNT(DISTINCT x) AS d, {", ".join(f"ANY_VALUE(x.{c}) AS {c}" for c in _VALUES)}
              FROM (SELECT transaction_id, struct_pack({", ".join(f"{c} := {c}" for c in _VALUES)}) AS x FROM come) GROUP BY 1)
        SELECT COALESCE(l.transaction_id, r.transaction_id) AS transaction_id,
               CASE WHEN r.n IS NULL THEN 'removed' WHEN l.n IS NULL THEN 'added' ELSE 'changed' END AS status,
               COALESCE(l.n, 0) AS rows_left, COALESCE(r.n, 0) AS rows_right,
               CASE WHEN l.d = 1 AND r.d = 1
                    THEN concat_ws(',', {", ".join(f"CASE WHEN l.{c} IS DISTINCT FROM r.{c} THEN '{c}' END" for c in _VALUES)}) END AS changed_columns
        FROM l FULL JOIN r ON l.transaction_id = r.transaction_id""",
)
def u5(t):
    """Transactions that were added, removed or changed between two extracts, and in which columns."""
    return reconcile.key_changes(*_extracts(t), ["transaction_id"])


@query(
    "q18_extract_drift",
    f"""WITH {_BOTH},
        per_key AS (SELECT transaction_id, SUM(l) AS l, SUM(r) AS r
                    FROM (SELECT transaction_id, 1 AS l, 0 AS r FROM gone UNION ALL SELECT transaction_id, 0, 1 FROM come) GROUP BY 1)
        SELECT CASE WHEN r = 0 THEN 'removed' WHEN l = 0 THEN 'added' ELSE 'changed' END AS status, COUNT(*) AS keys,
               CAST(SUM(l) AS BIGINT) AS rows_left, CAST(SUM(r) AS BIGINT) AS rows_right
        FROM per_key GROUP BY 1""",
)
def q18(t):
    """How far two extracts are apart."""
    return reconcile.change_summary(reconcile.key_changes(*_extracts(t), ["transaction_id"]))


_STEPS = ("signup", "view", "click", "purchase")
_WITHIN = timedelta(days=2)


def _before(x: str) -> str:
    """Latest ``x`` of rows strictly earlier than this one."""
    return f"""MAX({x}) OVER (PARTITION BY user_id ORDER BY event_timestamp
                              RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)"""


_REACHED = f"""
    s1 AS (SELECT user_id, event_timestamp, list_position({list(_STEPS)!r}, event_name) AS step FROM app_events
           WHERE event_name IN {_STEPS!r} AND user_id IS NOT NULL AND event_timestamp IS NOT NULL),
    s2 AS (SELECT *, CASE WHEN step = 1 THEN event_timestamp END AS b1 FROM s1),
    s3 AS (SELECT *, CASE WHEN step = 2 AND event_timestamp - {_before("b1")} <= INTERVAL 2 DAY THEN {_before("b1")} END AS b2 FROM s2),
    s4 AS (SELECT *, CASE WHEN step = 3 AND event_timestamp - {_before("b2")} <= INTERVAL 2 DAY THEN {_before("b2")} END AS b3 FROM s3),
    s5 AS (SELECT *, CASE WHEN step = 4 AND event_timestamp - {_before("b3")} <= INTERVAL 2 DAY THEN {_before("b3")} END AS b4 FROM s4),
    reached AS (SELECT user_id, MAX(CASE WHEN b4 IS NOT NULL THEN 4 WHEN b3 IS NOT NULL THEN 3 WHEN b2 IS NOT NULL THEN 2
                                         WHEN b1 IS NOT NULL THEN 1 ELSE 0 END) AS steps_reached FROM s5 GROUP BY user_id)"""


@query("m11_ordered_steps", f"WITH {_REACHED} SELECT user_id, steps_reached FROM reached")
def m11(t):
    """How many of four steps each user did in strict order within two days."""
    return steps.ordered_steps(t.events, _STEPS, _WITHIN)


@query(
    "a29_ordered_funnel",
    f"""WITH {_REACHED},
        tall AS (SELECT acquisition_channel, i AS step_number, ({list(_STEPS)!r})[i] AS step,
                        COUNT(*) FILTER (WHERE steps_reached >= i) AS users, COUNT(*) FILTER (WHERE steps_reached >= GREATEST(i - 1, 1)) AS before
                 FROM reached r JOIN app_users u ON u.user_id = r.user_id, (SELECT unnest([1, 2, 3, 4]) AS i) GROUP BY ALL)
        SELECT acquisition_channel, step_number, step, users, {base.pct("users", "before")} AS step_rate FROM tall""",
)
def a29(t):
    """The strictly ordered funnel of each channel."""
    reached = steps.ordered_steps(t.events, _STEPS, _WITHIN).join(t.users.select("user_id", "acquisition_channel"), "user_id")
    return steps.ordered_funnel(reached, _STEPS, ["acquisition_channel"])

"""Cleaning, the mart and its parts, joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.numeric import round_half_up
from tidemark.functions.temporal import days, elapsed, whole_second
from tidemark.operators import cleaning, joins, lifecycle, repeat
from tidemark.registry.base import query, rnd
from tidemark.sources.stand_in import PAIRS

_KEYS = "user_id, session_id, event_timestamp, event_name"


@query(
    "m1_clean_events",
    f"SELECT MIN(event_id) AS event_id, {_KEYS} FROM app_events GROUP BY {_KEYS}",
)
def m1(t):
    return cleaning.dedupe_by_key(t.events)


@query(
    "m1b_dedupe_report",
    f"""SELECT COUNT(*) AS raw_events, COUNT(DISTINCT ({_KEYS})) AS clean_events,
               COUNT(*) - COUNT(DISTINCT ({_KEYS})) AS removed_duplicates FROM app_events""",
)
def m1b(t):
    return cleaning.dedupe_report(t.events)


@query("m2_user_lifecycle", f"SELECT {', '.join(lifecycle.MART_COLUMNS)} FROM mart")
def m2(t):
    return t.mart


@query(
    "m2a_success_summary",
    """SELECT user_id, f AS first_successful_transaction_at, l AS last_successful_transaction_at,
              n AS successful_transaction_count, v AS successful_transaction_volume, tr AS target_rate_user_flag
       FROM per_user""",
)
def m2a(t):
    return lifecycle.success_summary(t.tx)


@query(
    "m2b_event_flag",
    "SELECT DISTINCT user_id, 1 AS rate_alert_user_flag FROM app_events WHERE event_name = 'rate_alert_created'",
)
def m2b(t):
    return lifecycle.event_flag(t.events, lifecycle.RATE_ALERT_EVENT, "rate_alert_user_flag")


@query(
    "m2c_elapsed",
    f"""SELECT event_id, {rnd("(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 864e8", 4)} AS age_days,
               {rnd("(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 36e8", 2)} AS age_hours FROM events""",
)
def m2c(t):
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    return t.raw("events").select(
        "event_id",
        round_half_up(elapsed(start, F.col("ts")), 4).alias("age_days"),
        round_half_up(elapsed(start, F.col("ts"), "hour"), 2).alias("age_hours"),
    )


@query(
    "m2e_onboarding_flags",
    "SELECT onboarding_valid_flag, activation_flag, COUNT(*) AS users FROM mart GROUP BY ALL",
)
def m2e(t):
    return t.mart.groupBy("onboarding_valid_flag", "activation_flag").agg(F.count(F.lit(1)).alias("users"))


@query(
    "m2d_zero_fill",
    """SELECT user_id, successful_transaction_count, successful_transaction_volume, target_rate_user_flag,
              rate_alert_user_flag FROM mart WHERE first_successful_transaction_at IS NULL""",
)
def m2d(t):
    """Users without any success carry zeros, not NULLs."""
    idle = t.mart.where(F.col("first_successful_transaction_at").isNull())
    return idle.select(
        "user_id",
        "successful_transaction_count",
        "successful_transaction_volume",
        "target_rate_user_flag",
        "rate_alert_user_flag",
    )


@query("m2f_activation", "SELECT user_id, activation_flag FROM mart")
def m2f(t):
    return t.mart.select("user_id", "activation_flag")


@query("m3_first_time", "SELECT user_id, f AS first_transaction_at FROM per_user")
def m3(t):
    return repeat.first_time(t.tx)


@query("m4_repeat_within", "SELECT user_id, d30_repeat_flag FROM repeats")
def m4(t):
    return t.repeat.select("user_id", "d30_repeat_flag")


@query(
    "m4b_repeat_censored",
    """SELECT r.user_id, CASE WHEN p.f + INTERVAL 30 DAY <= TIMESTAMP '2001-07-15' THEN r.d30_repeat_flag END
              AS d30_repeat_flag FROM repeats r JOIN per_user p ON p.user_id = r.user_id""",
)
def m4b(t):
    until = F.lit("2001-07-15").cast("timestamp_ntz")
    return repeat.repeat_within(t.tx, 30, censor_after=until).select("user_id", "d30_repeat_flag")


@query(
    "m5_ticket_summary",
    """SELECT user_id, COUNT(*) AS ticket_count, AVG(resolution_time_hours) AS avg_resolution_time_hours,
              AVG(satisfaction_score) AS avg_satisfaction_score FROM app_tickets GROUP BY user_id""",
)
def m5(t):
    return repeat.ticket_summary(t.tickets)


@query(
    "m8_user_context",
    """SELECT user_id, acquisition_channel, successful_transaction_count, successful_transaction_volume,
              target_rate_user_flag, rate_alert_user_flag FROM mart""",
)
def m8(t):
    return lifecycle.user_context(t.mart)


@query(
    "j1_left_join",
    """SELECT u.user_id, s.n AS ticket_count FROM app_users u
       LEFT JOIN (SELECT user_id, COUNT(*) AS n FROM app_tickets GROUP BY 1) s ON s.user_id = u.user_id""",
)
def j1(t):
    """As in the mart: facts become one row per user before the join."""
    summary = repeat.ticket_summary(t.tickets).select("user_id", "ticket_count")
    return t.users.select("user_id").join(summary, "user_id", "left")


@query(
    "j2_inner_join",
    """SELECT u.acquisition_channel, COUNT(*) AS tickets FROM app_users u
       INNER JOIN app_tickets s ON s.user_id = u.user_id GROUP BY ALL""",
)
def j2(t):
    counts = repeat.ticket_summary(t.tickets).select("user_id", "ticket_count")
    joined = t.users.select("user_id", "acquisition_channel").join(counts, "user_id", "inner")
    return joined.groupBy("acquisition_channel").agg(F.sum("ticket_count").alias("tickets"))


@query("j3_inner_using", "SELECT user_id, f AS first_at, d30_repeat_flag FROM per_user JOIN repeats USING (user_id)")
def j3(t):
    first = repeat.first_time(t.tx).withColumnRenamed("first_transaction_at", "first_at")
    return first.join(t.repeat.select("user_id", "d30_repeat_flag"), "user_id")


@query(
    "j4_left_with_right_filter",
    """SELECT u.user_id, COUNT(w.transaction_id) AS successes FROM app_users u
       LEFT JOIN app_tx w ON w.user_id = u.user_id AND w.transaction_type = 'exchange'
            AND w.transaction_status = 'completed' GROUP BY u.user_id""",
)
def j4(t):
    done = lifecycle.successful(t.tx).groupBy("user_id").agg(F.count(F.lit(1)).alias("successes"))
    joined = t.users.select("user_id").join(done, "user_id", "left")
    return joined.select("user_id", F.coalesce("successes", F.lit(0).cast("long")).alias("successes"))


@query(
    "j5_three_way_inner",
    """SELECT m.acquisition_channel, COUNT(*) AS exchanges FROM wins w
       JOIN per_user p ON p.user_id = w.user_id JOIN mart m ON m.user_id = w.user_id
       WHERE m.onboarding_valid_flag = 1 GROUP BY ALL""",
)
def j5(t):
    """Facts are counted per user before the two joins."""
    n = lifecycle.successful(t.tx).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    first = repeat.first_time(t.tx)
    who = lifecycle.valid_users(t.mart).select("user_id", "acquisition_channel")
    joined = n.join(first, "user_id").join(who, "user_id")
    return joined.groupBy("acquisition_channel").agg(F.sum("n").alias("exchanges"))


@query(
    "j6_within_join",
    """SELECT p.user_id, COUNT(*) AS exchanges_in_window FROM per_user p JOIN wins w ON w.user_id = p.user_id
        AND date_trunc('second', w.transaction_timestamp) > date_trunc('second', p.f)
        AND date_trunc('second', w.transaction_timestamp) <= date_trunc('second', p.f) + INTERVAL 30 DAY
       GROUP BY p.user_id""",
)
def j6(t):
    at = whole_second("transaction_timestamp").alias("at")
    instants = cleaning.key_counts(lifecycle.successful(t.tx).select("user_id", at), ["user_id", "at"])
    anchors = repeat.first_time(t.tx).select("user_id", whole_second("first_transaction_at").alias("start"))
    inside = joins.within_join(instants, anchors, "user_id", "at", "start", days(0), days(30))
    return inside.groupBy("user_id").agg(F.sum("n").alias("exchanges_in_window"))


@query(
    "j7_order_violation",
    """SELECT t.user_id, COUNT(*) AS early FROM app_tx t JOIN app_users u ON u.user_id = t.user_id
       WHERE t.transaction_timestamp < u.signup_timestamp + INTERVAL 15 DAY GROUP BY t.user_id""",
)
def j7(t):
    instants = cleaning.key_counts(t.tx, ["user_id", "transaction_timestamp"])
    due = t.users.select("user_id", (F.col("signup_timestamp") + days(15)).alias("due"))
    early = joins.order_violation_join(instants, due, "user_id", "transaction_timestamp", "due")
    return early.groupBy("user_id").agg(F.sum("n").alias("early"))


@query(
    "j8_checked_join",
    """SELECT m.user_id, m.acquisition_channel, r.d30_repeat_flag FROM mart m
       LEFT JOIN repeats r ON r.user_id = m.user_id""",
)
def j8(t):
    flags = t.repeat.select("user_id", "d30_repeat_flag")
    return joins.checked_join(t.mart.select("user_id", "acquisition_channel"), flags, ["user_id"], "one_to_one")


@query(
    "j9_multi_key_join",
    """SELECT s.user_id, CAST(s.observation_date AS VARCHAR) AS observation_date, s.repeat_probability,
              n.transactions_90d FROM scored s JOIN snaps n ON n.user_id = s.user_id
          AND n.observation_date = s.observation_date AND n.target_repeat_30d = s.target_repeat_30d""",
)
def j9(t):
    keys = ["user_id", "observation_date", "target_repeat_30d"]
    scores = t.scores.select(*keys, "repeat_probability")
    joined = scores.join(t.snapshot_table.select(*keys, "transactions_90d"), keys)
    return joined.drop("target_repeat_30d")


@query(
    "j10_orphans",
    """SELECT user_id, COUNT(*) AS orphan_rows FROM app_events
       WHERE user_id NOT IN (SELECT user_id FROM app_users WHERE user_id % 10 <> 3) GROUP BY user_id""",
)
def j10(t):
    return joins.orphans(t.events, t.users.where("user_id % 10 <> 3"), "user_id")


@query(
    "j12_outer_date_alignment",
    " ".join(
        [
            'SELECT CAST("date" AS VARCHAR) AS "date"',
            *[f", max(close) FILTER (WHERE pair = '{p}') AS {p.lower()}_close" for p in PAIRS],
            'FROM app_fx GROUP BY "date"',
        ]
    ),
)
def j12(t):
    """Closing prices of all pairs side by side, dates of any pair kept."""
    sides = [t.fx_daily.where(F.col("pair") == p).select("date", F.col("close").alias(f"{p.lower()}_close")) for p in PAIRS]
    joined = sides[0]
    for side in sides[1:]:
        joined = joined.join(side, "date", "full")
    return joined

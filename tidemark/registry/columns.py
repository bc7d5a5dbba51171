"""Projections, predicates, scalar functions, aggregates, windows, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import labels, temporal
from tidemark.functions.numeric import any_flag, clip, count_where, exact_avg, exact_sum, ratio, round_half_up
from tidemark.operators import cleaning, overview, quality, ranking, regimes
from tidemark.operators.lifecycle import successful
from tidemark.operators.snapshots import latest
from tidemark.registry.base import money, money_avg, pct, query, rnd, signed_rnd


@query("p1_projection", "SELECT transaction_id, user_id, transaction_status FROM app_tx")
def p1(t):
    return t.tx.select("transaction_id", "user_id", "transaction_status")


@query("p2_conjunctive_filter", "SELECT transaction_id, user_id FROM wins")
def p2(t):
    return successful(t.tx).select("transaction_id", "user_id")


@query(
    "p3_null_test",
    """SELECT kyc_completed_at IS NULL AS no_kyc, bank_account_linked_at IS NOT NULL AS has_bank, COUNT(*) AS users
       FROM app_users GROUP BY ALL""",
)
def p3(t):
    keys = [F.col("kyc_completed_at").isNull().alias("no_kyc"), F.col("bank_account_linked_at").isNotNull().alias("has_bank")]
    return t.users.groupBy(*keys).agg(F.count(F.lit(1)).alias("users"))


@query("p4_between", "SELECT transaction_id FROM app_tx WHERE transaction_amount_krw BETWEEN 100000 AND 200000")
def p4(t):
    return t.tx.where(F.col("transaction_amount_krw").between(100000, 200000)).select("transaction_id")


@query(
    "p5_not_in_domain",
    """SELECT failure_reason, COUNT(*) AS n FROM app_tx
       WHERE failure_reason NOT IN ('1-URGENT', '2-HIGH') OR failure_reason IS NULL GROUP BY 1""",
)
def p5(t):
    outside = t.tx.where(labels.not_in_domain("failure_reason", ["1-URGENT", "2-HIGH"]))
    return outside.groupBy("failure_reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p6_searched_case",
    """SELECT transaction_id, CASE WHEN transaction_amount_krw = 0 THEN 'none'
              WHEN transaction_amount_krw < 150000 THEN 'small' WHEN failed THEN 'failed' ELSE 'large' END AS label
       FROM app_tx""",
)
def p6(t):
    rules = [
        ("transaction_amount_krw = 0", "none"),
        ("transaction_amount_krw < 150000", "small"),
        ("transaction_status = 'failed'", "failed"),
    ]
    return t.tx.select("transaction_id", labels.first_match(rules, "large").alias("label"))


@query(
    "p7_recode",
    """SELECT transaction_id, CASE failure_reason WHEN '1-URGENT' THEN 1 WHEN '5-LOW' THEN 5 END AS priority
       FROM app_tx""",
)
def p7(t):
    return t.tx.select("transaction_id", labels.recode("failure_reason", {"1-URGENT": 1, "5-LOW": 5}).alias("priority"))


@query(
    "p8_map_with_default",
    """SELECT user_id, COALESCE(MAP {'AUTOMOBILE': CAST(0.03 AS DOUBLE), 'BUILDING': CAST(0.02 AS DOUBLE)}
              [acquisition_channel], CAST(0 AS DOUBLE)) AS adjustment FROM app_users""",
)
def p8(t):
    value = labels.map_with_default("acquisition_channel", {"AUTOMOBILE": 0.03, "BUILDING": 0.02}, 0.0)
    return t.users.select("user_id", value.alias("adjustment"))


@query(
    "p9_first_match",
    """SELECT user_id, CAST(observation_date AS VARCHAR) AS observation_date,
              CASE WHEN transactions_90d = 0 THEN 'idle' WHEN failed_ratio_90d >= 0.5 THEN 'failing'
                   WHEN recency_days < 10 THEN 'fresh' ELSE 'steady' END AS state FROM snaps""",
)
def p9(t):
    rules = [("transactions_90d = 0", "idle"), ("failed_ratio_90d >= 0.5", "failing"), ("recency_days < 10", "fresh")]
    return t.snapshots.select("user_id", "observation_date", labels.first_match(rules, "steady").alias("state"))


_EDGES = "user_id, CAST(observation_date AS VARCHAR) AS observation_date"


@query(
    "p10_bin_right",
    f"""SELECT {_EDGES}, CASE WHEN repeat_probability <= 0.35 THEN 'low' WHEN repeat_probability <= 0.70 THEN 'mid'
               WHEN repeat_probability <= 0.95 THEN 'high' END AS bin FROM scored""",
)
def p10(t):
    b = labels.bin_right("repeat_probability", [-0.01, 0.35, 0.70, 0.95], ["low", "mid", "high"])
    return t.scores.select("user_id", "observation_date", b.alias("bin"))


@query(
    "p11_bin_left",
    f"""SELECT {_EDGES}, CASE WHEN repeat_probability < 0.35 THEN 'low' WHEN repeat_probability < 0.70 THEN 'mid'
               ELSE 'high' END AS bin FROM scored""",
)
def p11(t):
    b = labels.bin_left("repeat_probability", [0.35, 0.70], ["low", "mid", "high"])
    return t.scores.select("user_id", "observation_date", b.alias("bin"))


@query("p12_clip", "SELECT event_id, LEAST(GREATEST(value, 5.0), 40.0) AS clipped FROM events")
def p12(t):
    return t.raw("events").select("event_id", clip("value", 5.0, 40.0).alias("clipped"))


@query(
    "p14_latest_period",
    """SELECT user_id, CAST(observation_date AS VARCHAR) AS observation_date, recency_days FROM newest""",
)
def p14(t):
    return latest(t.snapshot_table).select("user_id", "observation_date", "recency_days")


@query("p15_tagged_columns", "SELECT user_id, 'observed' AS data_source, acquisition_channel FROM app_users")
def p15(t):
    return t.users.withColumn("data_source", F.lit("observed")).select("user_id", "data_source", "acquisition_channel")


@query(
    "p16_clean_label",
    """SELECT event_id, upper(substr(replace(event_name, '_', ' '), 1, 1))
              || lower(substr(replace(event_name, '_', ' '), 2)) AS label FROM app_events""",
)
def p16(t):
    return t.events.select("event_id", labels.clean_label("event_name").alias("label"))


@query(
    "f1_date_functions",
    """SELECT transaction_id, CAST(CAST(date_trunc('month', transaction_timestamp) AS DATE) AS VARCHAR) AS month_start,
              strftime(transaction_timestamp, '%Y-%m') AS month_key,
              CAST(year(transaction_timestamp) * 12 + month(transaction_timestamp) - (1995 * 12 + 1) AS INTEGER)
                  AS month_offset,
              transaction_timestamp + INTERVAL 14 DAY AS due FROM app_tx""",
)
def f1(t):
    at = F.col("transaction_timestamp")
    start = F.lit("1995-01-15").cast("timestamp_ntz")
    return t.tx.select(
        "transaction_id",
        temporal.month_start(at).alias("month_start"),
        temporal.month_key(at).alias("month_key"),
        temporal.months_between_starts(start, at).alias("month_offset"),
        (at + temporal.days(14)).alias("due"),
    )


@query(
    "f2_math_functions",
    f"""SELECT event_id, {rnd("value", 1)} AS rounded, abs(value - 20) AS distance,
               {rnd("sqrt(value)", 8)} AS root, {signed_rnd("ln(value)", 8)} AS log_value
        FROM events WHERE value > 0""",
)
def f2(t):
    v = F.col("value")
    return t.raw("events").where(v > 0).select(
        "event_id",
        round_half_up(v, 1).alias("rounded"),
        F.abs(v - 20).alias("distance"),
        round_half_up(F.sqrt(v), 8).alias("root"),
        round_half_up(F.log(v), 8).alias("log_value"),
    )


@query(
    "f3_conditional_functions",
    """SELECT transaction_id, COALESCE(failure_reason, 'none') AS reason, NULLIF(transaction_amount_krw, 0) AS amount,
              CAST(trunc(transaction_amount_krw) AS BIGINT) AS whole_amount FROM app_tx""",
)
def f3(t):
    return t.tx.select(
        "transaction_id",
        F.coalesce("failure_reason", F.lit("none")).alias("reason"),
        F.nullif(F.col("transaction_amount_krw"), F.lit(0.0)).alias("amount"),
        F.col("transaction_amount_krw").cast("long").alias("whole_amount"),
    )


@query(
    "f4_string_functions",
    """SELECT event_id, lower(replace(session_id, '-', '/')) AS path, event_name || ', ' || session_id AS joined,
              printf('%.8f', CAST(event_id AS DOUBLE) / 8) AS fixed FROM app_events""",
)
def f4(t):
    return t.events.select(
        "event_id",
        F.lower(F.replace("session_id", F.lit("-"), F.lit("/"))).alias("path"),
        F.concat_ws(", ", "event_name", "session_id").alias("joined"),
        F.format_string("%.8f", F.col("event_id").cast("double") / 8).alias("fixed"),
    )


@query(
    "g1_counts",
    """SELECT COUNT(*) AS rows, COUNT(failure_reason) AS with_reason, COUNT(executed_rate) AS with_rate FROM app_tx""",
)
def g1(t):
    return t.tx.agg(
        F.count(F.lit(1)).alias("rows"), F.count("failure_reason").alias("with_reason"), F.count("executed_rate").alias("with_rate")
    )


@query(
    "g2_count_distinct",
    """SELECT transaction_status, COUNT(DISTINCT user_id) AS users, COUNT(DISTINCT failure_reason) AS reasons
       FROM app_tx GROUP BY 1""",
)
def g2(t):
    return t.tx.groupBy("transaction_status").agg(
        F.countDistinct("user_id").alias("users"), F.countDistinct("failure_reason").alias("reasons")
    )


@query(
    "g3_basic_aggregates",
    f"""SELECT transaction_type, {money("amount")} AS total, {rnd(money_avg("amount"), 4)} AS mean,
               MIN(amount) AS low, MAX(amount) AS high, MAX(transaction_timestamp) AS last_at FROM app_tx GROUP BY 1""",
)
def g3(t):
    a = "transaction_amount_krw"
    return t.tx.groupBy("transaction_type").agg(
        exact_sum(a).alias("total"),
        round_half_up(exact_avg(a), 4).alias("mean"),
        F.min(a).alias("low"),
        F.max(a).alias("high"),
        F.max("transaction_timestamp").alias("last_at"),
    )


@query(
    "g4_conditional_aggregates",
    """SELECT user_id, COUNT(*) FILTER (WHERE failed) AS failures,
              MAX(CASE WHEN order_type = 'target_rate' THEN 1 ELSE 0 END) AS any_target FROM app_tx GROUP BY user_id""",
)
def g4(t):
    return t.tx.groupBy("user_id").agg(
        count_where(F.col("transaction_status") == "failed").alias("failures"),
        any_flag(F.col("order_type") == "target_rate").alias("any_target"),
    )


@query(
    "g5_group_by_expression",
    """SELECT year(transaction_timestamp) AS year, transaction_amount_krw >= 250000 AS large, COUNT(*) AS n
       FROM app_tx GROUP BY ALL""",
)
def g5(t):
    keys = [F.year("transaction_timestamp").cast("long").alias("year"), (F.col("transaction_amount_krw") >= 250000).alias("large")]
    return t.tx.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query(
    "g6_having",
    "SELECT user_id, session_id, COUNT(*) AS n FROM app_events GROUP BY ALL HAVING COUNT(*) > 1",
)
def g6(t):
    return cleaning.key_counts(t.events, ["user_id", "session_id"]).where("n > 1")


@query("g7_distinct", "SELECT DISTINCT user_id, event_name FROM app_events")
def g7(t):
    return t.events.select("user_id", "event_name").distinct()


@query(
    "g8_exact_quantiles",
    " UNION ALL ".join(
        f"SELECT CAST({p} AS DOUBLE) AS p, {rnd(f'quantile_cont(transaction_amount_krw, {p})', 6)} AS value FROM app_tx"
        for p in (0.05, 0.25, 0.5, 0.75, 0.99)
    ),
)
def g8(t):
    """Exact interpolated quantiles of the whole column; only the five numbers reach the driver."""
    ps = (0.05, 0.25, 0.5, 0.75, 0.99)
    values = ranking.exact_quantiles(t.tx, "transaction_amount_krw", ps)
    rows = [F.struct(F.lit(p).alias("p"), F.lit(v).alias("value")) for p, v in zip(ps, values)]
    made = t.spark.range(1).select(F.inline(F.array(*rows)))
    return made.withColumn("value", round_half_up("value", 6))


@query(
    "g9_rollup_total",
    """SELECT COALESCE(transaction_status, 'all') AS status, COUNT(*) AS attempts, COUNT(DISTINCT user_id) AS users
       FROM app_tx GROUP BY ROLLUP (transaction_status)""",
)
def g9(t):
    rolled = t.tx.rollup("transaction_status").agg(
        F.count(F.lit(1)).alias("attempts"), F.countDistinct("user_id").alias("users")
    )
    return rolled.select(F.coalesce("transaction_status", F.lit("all")).alias("status"), "attempts", "users")


@query(
    "g10_rate",
    "SELECT acquisition_channel, AVG(activation_flag) AS activation FROM mart GROUP BY 1",
)
def g10(t):
    return t.mart.groupBy("acquisition_channel").agg(F.avg("activation_flag").alias("activation"))


@query(
    "g11_value_counts",
    """SELECT event_name, COUNT(*) AS rows, CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER () AS share
       FROM app_events GROUP BY event_name""",
)
def g11(t):
    return overview.balance(t.events, "event_name")


@query("g12_nunique", "SELECT COUNT(DISTINCT user_id) AS users FROM snaps")
def g12(t):
    return t.snapshots.agg(F.countDistinct("user_id").alias("users"))


@query(
    "w1_row_number",
    """SELECT user_id, transaction_id FROM (SELECT user_id, transaction_id, ROW_NUMBER() OVER
        (PARTITION BY user_id ORDER BY transaction_timestamp, transaction_id) AS rn FROM wins) WHERE rn <= 3""",
)
def w1(t):
    """First three exchanges per user; the limit is applied before the shuffle."""
    n = F.row_number().over(W.partitionBy("user_id").orderBy("transaction_timestamp", "transaction_id"))
    return successful(t.tx).withColumn("rn", n).where("rn <= 3").select("user_id", "transaction_id")


@query(
    "w2_share_window",
    f"""SELECT *, {pct("n", "SUM(n) OVER (PARTITION BY transaction_type)")} AS share
        FROM (SELECT transaction_type, order_type, COUNT(*) AS n FROM app_tx GROUP BY ALL)""",
)
def w2(t):
    return regimes.share_within(t.tx, ["transaction_type"], ["order_type"], "n", "share")


@query(
    "w3_ntile",
    "SELECT transaction_id, CAST(NTILE(4) OVER (ORDER BY transaction_amount_krw, transaction_id) AS INTEGER) AS tile FROM app_tx",
)
def w3(t):
    rows = t.tx.select("transaction_id", "transaction_amount_krw")
    return ranking.ntile_scalable(rows, "transaction_amount_krw", "transaction_id", 4, "tile").select("transaction_id", "tile")


@query(
    "w3b_global_rank",
    "SELECT transaction_id, ROW_NUMBER() OVER (ORDER BY transaction_amount_krw DESC, transaction_id DESC) AS global_rank FROM app_tx",
)
def w3b(t):
    rows = t.tx.select("transaction_id", "transaction_amount_krw")
    ranked = ranking.global_rank(rows, "transaction_amount_krw", "transaction_id", descending=True)
    return ranked.select("transaction_id", "global_rank")


@query(
    "w11_best_per_group",
    """SELECT acquisition_channel, user_id, successful_transaction_count FROM mart
       QUALIFY ROW_NUMBER() OVER (PARTITION BY acquisition_channel
                                  ORDER BY successful_transaction_count DESC, user_id) = 1""",
)
def w11(t):
    best = ranking.best_per(t.mart, ["acquisition_channel"], F.desc("successful_transaction_count"), "user_id")
    return best.select("acquisition_channel", "user_id", "successful_transaction_count")


@query(
    "w12_best_overall",
    """SELECT user_id, successful_transaction_volume FROM mart
       ORDER BY successful_transaction_volume DESC, user_id LIMIT 1""",
)
def w12(t):
    return ranking.best(t.mart, F.desc("successful_transaction_volume"), "user_id").select(
        "user_id", "successful_transaction_volume"
    )


@query(
    "j13_best_pair",
    """SELECT a.acquisition_channel, a.user_id AS user_id_by_count, b.user_id AS user_id_by_volume
       FROM (SELECT acquisition_channel, user_id FROM mart QUALIFY ROW_NUMBER() OVER
              (PARTITION BY acquisition_channel ORDER BY successful_transaction_count DESC, user_id) = 1) a
       LEFT JOIN (SELECT acquisition_channel, user_id FROM mart QUALIFY ROW_NUMBER() OVER
              (PARTITION BY acquisition_channel ORDER BY successful_transaction_volume DESC, user_id) = 1) b
         ON b.acquisition_channel = a.acquisition_channel""",
)
def j13(t):
    slim = t.mart.select("acquisition_channel", "user_id", "successful_transaction_count", "successful_transaction_volume")
    pair = ranking.best_pair(
        slim,
        "acquisition_channel",
        "user_id",
        ("by_count", [F.desc("successful_transaction_count")]),
        ("by_volume", [F.desc("successful_transaction_volume")]),
    )
    return pair.select("acquisition_channel", "user_id_by_count", "user_id_by_volume")


def _numbered(ordered):
    """A few sorted rows with their place: one partition keeps the order they come in."""
    return ordered.coalesce(1).select("*", F.monotonically_increasing_id().alias("position"))


@query(
    "o1_multi_key_sort",
    """SELECT acquisition_channel, onboarding_valid_flag, COUNT(*) AS users,
              row_number() OVER (ORDER BY COUNT(*) DESC, acquisition_channel, onboarding_valid_flag) - 1 AS position
       FROM mart GROUP BY 1, 2""",
)
def o1(t):
    """The sorted rows with their place in the output, so that the order itself is compared."""
    counts = t.mart.groupBy("acquisition_channel", "onboarding_valid_flag").agg(F.count(F.lit(1)).alias("users"))
    return _numbered(counts.orderBy(F.desc("users"), F.asc("acquisition_channel"), F.asc("onboarding_valid_flag")))


_regime_rank = (
    "CASE market_regime " + " ".join(f"WHEN '{r}' THEN {i}" for i, r in enumerate(regimes.REGIME_ORDER)) + " ELSE 99 END, market_regime"
)


@query(
    "o2_sort_by_rank",
    f"""SELECT *, row_number() OVER (ORDER BY {_regime_rank}) - 1 AS position
        FROM (SELECT market_regime, COUNT(*) AS hours FROM app_rates GROUP BY 1)""",
)
def o2(t):
    counts = t.rates.groupBy("market_regime").agg(F.count(F.lit(1)).alias("hours"))
    return _numbered(regimes.sort_by_rank(counts, "market_regime", regimes.REGIME_ORDER))


@query(
    "o3_head_tail",
    """(SELECT 'head' AS side, transaction_id FROM app_tx ORDER BY transaction_timestamp, transaction_id LIMIT 10)
       UNION ALL (SELECT 'tail', transaction_id FROM app_tx ORDER BY transaction_id DESC LIMIT 10)""",
)
def o3(t):
    first = overview.head(t.tx, 10, "transaction_timestamp", "transaction_id")
    last = overview.tail(t.tx, 10, "transaction_id")
    side = [F.lit("head").alias("side"), "transaction_id"]
    return first.select(*side).unionByName(last.select(F.lit("tail").alias("side"), "transaction_id"))


@query(
    "u1_union_all",
    """SELECT user_id, 'ticket' AS kind FROM app_tickets UNION ALL
       SELECT user_id, 'signup' AS kind FROM app_users""",
)
def u1(t):
    tickets = t.tickets.select("user_id", F.lit("ticket").alias("kind"))
    return quality.union([tickets, t.users.select("user_id", F.lit("signup").alias("kind"))])


@query(
    "u2_concatenation",
    """SELECT market_regime_at_transaction AS name, COUNT(*) AS n FROM app_tx GROUP BY 1
       UNION ALL SELECT event_name, COUNT(*) FROM app_events GROUP BY 1
       UNION ALL SELECT acquisition_channel, COUNT(*) FROM app_users GROUP BY 1""",
)
def u2(t):
    parts = ((t.tx, "market_regime_at_transaction"), (t.events, "event_name"), (t.users, "acquisition_channel"))
    return quality.union([df.groupBy(F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("n")) for df, c in parts])


@query(
    "g4b_success_ratio",
    """SELECT user_id, CAST(COUNT(*) FILTER (WHERE NOT failed) AS DOUBLE)
              / NULLIF(COUNT(*) FILTER (WHERE transaction_type = 'exchange'), 0) AS success_per_exchange
       FROM app_tx GROUP BY user_id""",
)
def g4b(t):
    done = count_where(F.col("transaction_status") == "completed")
    tried = count_where(F.col("transaction_type") == "exchange")
    return t.tx.groupBy("user_id").agg(ratio(done, tried).alias("success_per_exchange"))

"""The product tables expressed over a star schema of orders, customers, events and conversations.

Used by the registered queries and the benchmark, where only that schema is at hand.  Every column is a
deterministic expression, so the same mapping can be stated in any SQL engine.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.labels import first_match
from tidemark.functions.numeric import exact_avg, exact_sum
from tidemark.operators.experiment import assign_variant, lifetime_value_segment
from tidemark.operators.lifecycle import user_context, user_lifecycle, valid_users
from tidemark.operators.market import fx_features
from tidemark.operators.repeat import repeat_within
from tidemark.operators.snapshots import build_snapshots, last_complete_month_end, latest
from tidemark.operators.targeting import targeting
from tidemark.plans.staging import staged
from tidemark.schemas import declare
from tidemark.sources.tables import read_table

RAW_SCHEMAS = {
    "customer": declare("c_custkey:long c_name:string c_nationkey:int c_acctbal:double c_mktsegment:string"),
    "orders": declare(
        "o_orderkey:long o_custkey:long o_orderstatus:string o_totalprice:double o_orderdate:ts "
        "o_orderpriority:string"
    ),
    "lineitem": declare(
        "l_orderkey:long l_partkey:long l_suppkey:long l_linenumber:int l_quantity:double l_extendedprice:double "
        "l_discount:double l_tax:double l_returnflag:string l_linestatus:string l_shipdate:ts"
    ),
    "events": declare("event_id:long ts:ts user_id:long event_type:string value:double props:string"),
    "conversations": declare("conv_id:long turn:long role:string text:string"),
}
PAIRS = ("A", "N", "R")
MAIN_PAIR = "N"
CHANNELS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
REGIME_RULES = "CASE WHEN {k} % 7 < 3 THEN 'low' WHEN {k} % 7 < 6 THEN 'normal' ELSE 'high' END"


class ProductTables:
    """The product tables of one data folder; each is built on first use and stays a lazy frame."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.directory, name, RAW_SCHEMAS[name])

    @cached_property
    def users(self) -> DataFrame:
        first = self.raw("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").alias("d"))
        base = self.raw("customer").join(first, "c_custkey", "left")
        key = F.col("c_custkey")
        start = F.coalesce("d", F.lit("1995-01-01").cast("timestamp_ntz"))
        signup = start - F.make_dt_interval((key % 23).cast("int"))
        kyc = F.when(key % 4 != 1, F.col("signup_timestamp") + F.make_dt_interval((key % 5).cast("int")))
        bank = F.when(
            F.col("kyc_completed_at").isNotNull() & (key % 6 != 2),
            F.col("signup_timestamp") + F.make_dt_interval((key % 5 + 1).cast("int")),
        )
        return (
            base.withColumn("signup_timestamp", signup)
            .withColumn("kyc_completed_at", kyc)
            .withColumn("bank_account_linked_at", bank)
            .select(
                key.alias("user_id"),
                "signup_timestamp",
                F.col("c_mktsegment").alias("acquisition_channel"),
                "kyc_completed_at",
                "bank_account_linked_at",
            )
        )

    @cached_property
    def tx(self) -> DataFrame:
        key, cust, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
        failed = (F.col("o_orderstatus") == "P") | ((cust % 4 == 1) & (cust % 40 != 1))
        target = (F.col("o_orderpriority") == "1-URGENT") & (key % 3 == 0)
        amount = F.when(key % 400 == 0, 0.0).otherwise(price)
        return self.raw("orders").select(
            key.alias("transaction_id"),
            cust.alias("user_id"),
            F.col("o_orderdate").alias("transaction_timestamp"),
            F.when(key % 20 == 0, "deposit").otherwise("exchange").alias("transaction_type"),
            F.when(target, "target_rate").otherwise("manual").alias("order_type"),
            amount.alias("transaction_amount_krw"),
            (amount * 0.00025).alias("fee_amount_krw"),
            F.when(failed, "failed").otherwise("completed").alias("transaction_status"),
            F.when(failed, F.col("o_orderpriority")).alias("failure_reason"),
            F.when(~failed, 1.0).alias("executed_rate"),
            F.expr(REGIME_RULES.format(k="o_orderkey")).alias("market_regime_at_transaction"),
        )

    @cached_property
    def events(self) -> DataFrame:
        alert = (F.col("event_type") == "click") & (F.col("user_id") % 3 == 0)
        hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
        day = F.col("ts").cast("date").cast("string")
        return self.raw("events").select(
            "event_id",
            "user_id",
            F.concat_ws("-", F.col("user_id").cast("string"), day).alias("session_id"),
            hour.alias("event_timestamp"),
            first_match([(alert, "rate_alert_created")], F.col("event_type")).alias("event_name"),
        )

    @cached_property
    def tickets(self) -> DataFrame:
        turns = self.raw("conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
        key = F.col("conv_id")
        return turns.select(
            key.alias("ticket_id"),
            (key % 70).alias("user_id"),
            F.col("turns").cast("double").alias("resolution_time_hours"),
            (1 + key % 5).cast("double").alias("satisfaction_score"),
        )

    @cached_property
    def rates(self) -> DataFrame:
        hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("timestamp")
        hourly = self.raw("events").groupBy(hour, F.col("event_type").alias("currency_pair"))
        return hourly.agg(exact_avg("value").alias("close_rate")).withColumn(
            "market_regime", F.expr(REGIME_RULES.format(k="hour(`timestamp`)"))
        )

    @cached_property
    def spend(self) -> DataFrame:
        daily = self.raw("events").groupBy(F.col("ts").cast("date").alias("date"), F.col("event_type").alias("channel"))
        return daily.agg(exact_sum("value").alias("spend_krw"), F.count(F.lit(1)).alias("impressions")).withColumn(
            "campaign_id", F.when(F.col("channel") != "error", F.concat(F.lit("c-"), F.col("channel")))
        )

    @cached_property
    def fx_daily(self) -> DataFrame:
        price = "l_extendedprice"
        daily = self.raw("lineitem").groupBy(
            F.col("l_returnflag").alias("pair"), F.col("l_shipdate").cast("date").alias("date")
        )
        return daily.agg(
            F.min(price).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            exact_avg(price).alias("close"),
        )

    @cached_property
    def mart(self) -> DataFrame:
        return user_lifecycle(self.users, self.tx, self.events)

    @cached_property
    def repeat(self) -> DataFrame:
        return repeat_within(self.tx, 30)

    @cached_property
    def snapshots(self) -> DataFrame:
        return build_snapshots(self.tx, last_complete_month_end(self.tx))

    @cached_property
    def snapshot_table(self) -> DataFrame:
        """The snapshots as a written table, which is what scoring, targeting and training read."""
        return staged(self.snapshots, "snapshots")

    @cached_property
    def scores(self) -> DataFrame:
        """A fixed score per snapshot, so rules and metrics can be checked apart from any fitted model."""
        point = (F.col("user_id") * 37 + F.col("recency_days") * 11) % 101
        return self.snapshot_table.select(
            "user_id",
            "observation_date",
            "target_repeat_30d",
            (point.cast("double") / 100).alias("repeat_probability"),
            F.when(point >= 50, 1).otherwise(0).alias("predicted_repeat_30d"),
        )

    @cached_property
    def latest_scores(self) -> DataFrame:
        return latest(self.scores)

    def targeting(self, rules: str) -> DataFrame:
        return targeting(self.latest_scores, self.snapshot_table, user_context(self.mart), rules)

    @cached_property
    def trial(self) -> DataFrame:
        """Valid users with a variant and three observed outcomes."""
        ticketed = self.tickets.select("user_id").distinct().withColumn("ticketed", F.lit(1))
        people = assign_variant(valid_users(self.mart), "user_id", "spring").join(ticketed, "user_id", "left")
        return people.select(
            "user_id",
            "acquisition_channel",
            lifetime_value_segment().alias("value_segment"),
            "variant",
            F.greatest("rate_alert_user_flag", "target_rate_user_flag").alias("feature_adoption_7d"),
            F.col("activation_flag").alias("first_exchange_14d"),
            F.coalesce("ticketed", F.lit(0)).alias("guardrail_event_30d"),
        )

    @cached_property
    def fx_features(self) -> DataFrame:
        return fx_features(self.fx_daily, MAIN_PAIR, PAIRS)

    @cached_property
    def fx_table(self) -> DataFrame:
        return staged(self.fx_features, "fx-features")

    @property
    def all(self) -> dict[str, DataFrame]:
        return {
            "users": self.users,
            "events": self.events,
            "transactions": self.tx,
            "support_tickets": self.tickets,
            "marketing_spend": self.spend,
            "fx_rates_hourly": self.rates,
            "modeling_user_month_snapshots": self.snapshots,
        }

"""The user lifecycle as streaming state: one small state per user, updated by sign-ups, transactions and events in any order.

What a user's state holds (first and last instant, counts, fixed-point sums, flags) merges in any order, so late and
shuffled rows are merged like others.  State is kept by user and by the span of time in which rows arrive, the state's
generation; a generation is forgotten some time after its span, which bounds the state, and generations merge like rows do.
``merged`` turns what the stream has written into the batch mart, row for row.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.lifecycle import COMPLETED, EXCHANGE, RATE_ALERT_EVENT, TARGET_RATE_ORDER, lifecycle_columns

#: State lies in RocksDB, so it isn't bounded by the executors' memory.  Without the second setting a run over the input at
#: hand would go on with empty batches to forget states; they are forgotten in the next batch that has rows.
RUN_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}

#: Earliest and highest values of a user's rows; instants are microseconds.
_LEAST = ("signup_us", "channel", "kyc_us", "bank_us", "first_us")
_GREATEST = ("known", "last_us", "target", "alert")
INPUT = (
    "user_id long, known int, signup_us long, channel string, kyc_us long, bank_us long, first_us long, last_us long, n long, "
    "volume decimal(28,8), target int, alert int"
)
OUTPUT = INPUT.replace("(28,8)", "(38,8)") + ", generation long, version long"


def _us(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def milestone_rows(users: DataFrame, tx: DataFrame, events: DataFrame) -> DataFrame:
    """The three streams in one form; only completed exchanges and the alert event pass."""

    def made(df: DataFrame, **have: Column) -> DataFrame:
        fields = [f.split(" ") for f in INPUT.split(", ")]
        return df.select(*[have.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields])

    people = made(
        users, user_id=F.col("user_id"), known=F.lit(1), signup_us=_us("signup_timestamp"), channel=F.col("acquisition_channel"),
        kyc_us=_us("kyc_completed_at"), bank_us=_us("bank_account_linked_at"),
    )
    done = tx.where((F.col("transaction_type") == EXCHANGE) & (F.col("transaction_status") == COMPLETED))
    at = _us("transaction_timestamp")
    trades = made(
        done, user_id=F.col("user_id"), first_us=at, last_us=at, n=F.lit(1), volume=F.col("transaction_amount_krw").cast("decimal(28,8)"),
        target=(F.col("order_type") == TARGET_RATE_ORDER).cast("int"),
    )
    alerts = made(events.where(F.col("event_name") == RATE_ALERT_EVENT), user_id=F.col("user_id"), alert=F.lit(1))
    return people.union(trades).union(alerts).where("user_id IS NOT NULL")


def milestone_stream(users: DataFrame, tx: DataFrame, events: DataFrame, idle: timedelta | None = timedelta(days=90)) -> DataFrame:
    """A row for each user that a batch has rows of: the merged values so far, with the state's generation and version.

    A generation holds the rows that arrive in one span of ``idle`` and is forgotten once a row arrives ``idle`` after its end.
    Without ``idle`` a user has one generation, which is kept.  Versions are the rows merged so far.
    """
    rows, keys, generation = milestone_rows(users, tx, events), ["user_id"], F.lit(0)
    if idle is not None:
        span = f"{idle // timedelta(milliseconds=1)} milliseconds"
        # Rows carry the time of their batch, so none is late unless the clock was put back by more than ``idle``.
        rows = rows.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", span)
        keys, generation = [*keys, F.window("arrived", span).alias("span")], F.unix_millis("span.start")
    made = rows.groupBy(*keys).agg(
        *[F.min(c).alias(c) for c in _LEAST],
        *[F.max(c).alias(c) for c in _GREATEST],
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum("volume"), F.lit(0)).cast("decimal(38,8)").alias("volume"),
        F.count(F.lit(1)).alias("version"),
    )
    made = made.withColumn("generation", generation.cast("long"))
    return made.select(*[field.split(" ")[0] for field in OUTPUT.split(", ")])


def start(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write ``milestone_stream`` as Parquet until all input at hand is read; the same checkpoint goes on where it stopped.

    Each batch has a folder of its own, so one that is run again after a failure replaces what it wrote.
    """
    spark = stream.sparkSession
    before = {name: spark.conf.get(name) for name in RUN_CONF}

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    for name, value in RUN_CONF.items():
        spark.conf.set(name, value)
    try:
        updates = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        return updates.foreachBatch(write).trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def merged(spark: SparkSession, path: str, activation_days: int = 14) -> DataFrame:
    """The user lifecycle mart from what the stream has written: the newest version of each generation, generations merged.

    Rows of users who never signed up aren't in the mart, as in the batch form.
    """
    written = spark.read.schema(OUTPUT).parquet(path)
    newest = F.row_number().over(W.partitionBy("user_id", "generation").orderBy(F.desc("version")))
    kept = written.withColumn("nth", newest).where("nth = 1")
    instant = lambda c: F.timestamp_micros(F.min(c)).cast("timestamp_ntz")
    flag = lambda c: F.coalesce(F.max(c), F.lit(0))
    whole = kept.groupBy("user_id").agg(
        F.max("known").alias("known"),
        instant("signup_us").alias("signup_timestamp"),
        F.min("channel").alias("acquisition_channel"),
        instant("kyc_us").alias("kyc_completed_at"),
        instant("bank_us").alias("bank_account_linked_at"),
        instant("first_us").alias("first_successful_transaction_at"),
        F.timestamp_micros(F.max("last_us")).cast("timestamp_ntz").alias("last_successful_transaction_at"),
        F.sum("n").alias("successful_transaction_count"),
        F.sum("volume").cast("double").alias("successful_transaction_volume"),
        flag("target").alias("target_rate_user_flag"),
        flag("alert").alias("rate_alert_user_flag"),
    )
    return lifecycle_columns(whole.where("known = 1").drop("known"), activation_days)


def session_stream(
    events: DataFrame, gap: str = "12 hours", delay: str = "2 hours", user: str = "user_id", at: str = "event_timestamp"
) -> DataFrame:
    """``timeline.sessions`` over a stream: a session is written when the watermark has passed its end by ``gap``.

    Events later than ``delay`` behind the newest are dropped, as a closed session can't be opened again.
    """
    timed = events.dropna(subset=[user]).withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    found = timed.groupBy(F.session_window(at, gap).alias("w"), user).agg(
        F.min(at).alias("session_start"), F.max(at).alias("session_end"), F.count(F.lit(1)).alias("events")
    )
    return found.drop("w")

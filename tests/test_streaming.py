from __future__ import annotations

from helpers import events, rows, tx
from pyspark.sql import functions as F

from tidemark.operators import cleaning, regimes
from tidemark.streaming import incremental


def drained(spark, df, folder, schema, build, name, mode):
    """Write rows as files, read them as a stream, run to the end and return the sink table."""
    df.write.mode("overwrite").parquet(str(folder / "in"))
    stream = spark.readStream.schema(schema).parquet(str(folder / "in"))
    q = (
        build(stream)
        .writeStream.format("memory")
        .queryName(name)
        .outputMode(mode)
        .option("checkpointLocation", str(folder / "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination(120)
    return spark.table(name)


def test_dedupe_stream_keeps_one_row_per_key(spark, tmp_path):
    df = events(spark, [(i, i % 3, "s", f"2024-01-01T0{i % 2}:00:00", "view") for i in range(30)])
    out = drained(spark, df, tmp_path, df.schema, incremental.dedupe_stream, "clean_stream", "append")
    keys = ["user_id", "session_id", "event_name", "event_timestamp"]
    batch = cleaning.dedupe_by_key(df).withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp"))
    assert rows(out.select(*keys)) == rows(batch.select(*keys))


def test_regime_stream_adds_up_to_the_batch_report(spark, tmp_path):
    df = tx(
        spark,
        [(i, f"2024-01-01T0{i % 4}:10:00", {"regime": ["low", "high"][i % 2], "status": ["completed", "failed"][i % 3 == 0]}) for i in range(40)],
    )
    out = drained(spark, df, tmp_path, df.schema, incremental.regime_behavior_stream, "regime_stream", "complete")
    total = out.groupBy("market_regime_at_transaction").agg(F.sum("transaction_attempts"), F.sum("successful_transactions"))
    batch = regimes.regime_behavior(df).select("market_regime_at_transaction", "transaction_attempts", "successful_transactions")
    assert rows(total) == rows(batch)


def test_flag_stream(spark, tmp_path):
    df = events(spark, [(i, i % 2, "s", "2024-01-01T00:00:00", "rate_alert_created" if i > 3 else "view") for i in range(10)])
    out = drained(spark, df, tmp_path, df.schema, lambda s: incremental.flag_stream(s, "rate_alert_created"), "flags", "append")
    assert sorted(r["user_id"] for r in out.collect()) == [0, 1]

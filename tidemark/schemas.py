"""Declared schemas of the source tables; nothing is inferred at scan time."""

from __future__ import annotations

from pyspark.sql import types as T

_SPARK_TYPES = {
    "long": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "ts": T.TimestampNTZType(),
    "date": T.DateType(),
}


def declare(spec: str) -> T.StructType:
    fields = (part.split(":") for part in spec.split())
    return T.StructType([T.StructField(name, _SPARK_TYPES[kind], True) for name, kind in fields])


USERS = declare(
    "user_id:long signup_timestamp:ts country:string city_type:string age_group:string device_os:string "
    "acquisition_channel:string campaign_id:string preferred_currency_pair:string kyc_status:string "
    "kyc_completed_at:ts bank_account_linked_at:ts"
)
EVENTS = declare(
    "event_id:long user_id:long session_id:string event_timestamp:ts event_name:string screen_name:string "
    "device_os:string currency_pair:string campaign_id:string"
)
TRANSACTIONS = declare(
    "transaction_id:long user_id:long transaction_timestamp:ts currency_pair:string transaction_type:string "
    "order_type:string transaction_amount_krw:double quoted_rate:double executed_rate:double "
    "fee_amount_krw:double cashback_krw:double transaction_status:string failure_reason:string "
    "processing_seconds:double market_regime_at_transaction:string"
)
FX_RATES_HOURLY = declare(
    "timestamp:ts currency_pair:string open_rate:double high_rate:double low_rate:double close_rate:double "
    "log_return:double rolling_volatility_24h:double market_regime:string"
)
MARKETING_SPEND = declare(
    "date:date campaign_id:string channel:string market:string spend_krw:double impressions:long clicks:long"
)
SUPPORT_TICKETS = declare(
    "ticket_id:long user_id:long created_at:ts issue_type:string resolution_time_hours:double "
    "resolved_flag:int satisfaction_score:double"
)
SNAPSHOTS = declare(
    "user_id:long observation_date:date recency_days:int transactions_90d:long transactions_all:long "
    "total_volume_90d:double failed_ratio_90d:double target_repeat_30d:int"
)
FX_DAILY = declare("pair:string date:date open:double high:double low:double close:double")

SOURCE_TABLES = {
    "users": USERS,
    "events": EVENTS,
    "transactions": TRANSACTIONS,
    "fx_rates_hourly": FX_RATES_HOURLY,
    "marketing_spend": MARKETING_SPEND,
    "support_tickets": SUPPORT_TICKETS,
    "modeling_user_month_snapshots": SNAPSHOTS,
}

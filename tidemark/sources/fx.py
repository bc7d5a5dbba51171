"""The daily market file: wide CSV in, long frame out, and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRICE_FIELDS = ("open", "high", "low", "close", "adj_close")


def wide_schema(pairs: Sequence[str], fields: Sequence[str] = PRICE_FIELDS) -> T.StructType:
    """``date`` and one price column per pair and field, in file order."""
    schema = T.StructType([T.StructField("date", T.DateType())])
    for pair in pairs:
        for field in fields:
            schema = schema.add(f"{pair}_{field}", T.DoubleType())
    return schema


def normalise_names(df: DataFrame, prefix: str, keep: Sequence[str] = ("date",)) -> DataFrame:
    """``Adj Close`` becomes ``<prefix>_adj_close``."""
    renamed = {c: f"{prefix}_{c.lower().replace(' ', '_')}" for c in df.columns if c not in keep}
    return df.withColumnsRenamed(renamed)


def to_long(wide: DataFrame, pairs: Sequence[str], fields: Sequence[str] = ("open", "high", "low", "close")):
    """One row per (pair, date); days without any price of the pair are dropped."""
    rows = [
        F.struct(F.lit(p).alias("pair"), *[F.col(f"{p}_{f}").alias(f) for f in fields])
        for p in pairs
    ]
    long = wide.select("date", F.inline(F.array(*rows)))
    return long.dropna(how="all", subset=list(fields)).select("pair", "date", *fields)


def read_fx_daily(
    spark: SparkSession, path: str, pairs: Sequence[str], fields: Sequence[str] = PRICE_FIELDS
) -> DataFrame:
    """Read the wide daily CSV with a declared schema and return it long."""
    wide = spark.read.csv(path, header=True, schema=wide_schema(pairs, fields), enforceSchema=False)
    return to_long(wide, pairs)


def source_profile(fx: DataFrame, provider: str) -> DataFrame:
    """First and last date and number of dates of a market source."""
    dates = fx.select("date").distinct()
    return dates.agg(
        F.min("date").cast("string").alias("first_observation"),
        F.max("date").cast("string").alias("last_observation"),
        F.count(F.lit(1)).alias("rows"),
    ).select(F.lit(provider).alias("provider"), "first_observation", "last_observation", "rows")

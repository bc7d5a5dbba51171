"""Proportional stratified interleaving: shards that each hold every source in its share of the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.staging import staged

SHARDS = 24
SEED = 7
#: Rows that one task orders.  The number of ranges follows the number of rows, and is no less than that of shuffle parts.
RANGE_ROWS = 1 << 17


def _ranges(rows: DataFrame, range_rows: int) -> int:
    return max(-(-rows.count() // range_rows), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _unit(h: Column) -> Column:
    """A hash as a number from 0 up to, not including, 1."""
    return F.shiftrightunsigned(h, 11).cast("double") / float(1 << 53)


def fractional_ranks(rows: DataFrame, by: str, order: list[str], seed: int = SEED, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` as a struct ``row`` with ``stratum``, ``rank`` (from 0) in a seeded shuffle of the stratum, and ``fraction``.

    The fraction is (rank + phase) / size of the stratum with a phase of its own for each stratum, so that strata of
    one row spread over the whole as well.  A stratum is cut by the leading bits of the shuffling hash, so one with a
    third of all rows is ordered by many tasks; counts of the cuts give each its first rank.
    """
    ranges = _ranges(rows, range_rows)
    hashed = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"),
        F.coalesce(F.col(f"`{by}`").cast("string"), F.lit("")).alias("stratum"),
        F.col(f"`{by}`").isNull().alias("unknown"),
        F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in order]).alias("h"),
    ).withColumn("cut", F.floor(_unit(F.col("h")) * ranges))
    stratum = ["stratum", "unknown"]
    counts = hashed.groupBy(*stratum, "cut").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*stratum)
    firsts = counts.select(
        *stratum,
        "cut",
        (F.sum("n").over(whole.orderBy("cut")) - F.col("n")).alias("first"),
        F.sum("n").over(whole).alias("size"),
    )
    within = Window.partitionBy(*stratum, "cut").orderBy("h", *[F.col("row").getField(c) for c in order])
    ranked = hashed.withColumn("place", F.row_number().over(within) - 1).join(staged(firsts, "interleave-firsts"), [*stratum, "cut"])
    phase = _unit(F.xxhash64(F.lit(seed), *stratum))
    rank = F.col("first") + F.col("place")
    return ranked.select("row", *stratum, rank.alias("rank"), ((rank + phase) / F.col("size")).alias("fraction"))


def interleaved(
    rows: DataFrame,
    by: str = "source",
    order: list[str] | None = None,
    shards: int = SHARDS,
    seed: int = SEED,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """``rows`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in the shard).

    Rows are ranked within each value of ``by`` by a seeded hash of ``order`` (default: all columns), put into one
    sequence by fractional rank, and the sequence is cut into shards whose row counts differ by at most one; each
    shard then holds each source in its share, up to one row or so.  A null source is a stratum of its own.
    Rows equal in ``order`` are interchangeable; rows of an empty table give none.  Input columns named shard or
    slot are replaced.  Texts needn't come along: give narrow rows and join by id when writing.
    """
    order = order or [c for c in rows.columns if c != by]
    slotted = staged(fractional_ranks(rows, by, order, seed, range_rows), "interleave-ranks")
    total, ranges = slotted.count(), _ranges(slotted, range_rows)
    slotted = slotted.withColumn("cut", F.least(F.floor(F.col("fraction") * ranges), F.lit(ranges - 1)))
    # One row for each range: a few thousand at most where a range holds RANGE_ROWS rows of a large corpus.
    counts = slotted.groupBy("cut").agg(F.count(F.lit(1)).alias("n"))
    firsts = counts.select("cut", (F.sum("n").over(Window.orderBy("cut")) - F.col("n")).alias("first"))
    within = Window.partitionBy("cut").orderBy("fraction", "stratum", "unknown", "rank")
    placed = slotted.withColumn("place", F.row_number().over(within) - 1).join(firsts, "cut")
    whole = f"{max(total, 1)}L"
    sharded = placed.withColumn("at", F.col("first") + F.col("place")).withColumn("shard", F.expr(f"at * {shards} div {whole}"))
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    return sharded.select(
        *[F.col("row").getField(c).alias(c) for c in kept],
        F.col("shard").cast("int").alias("shard"),
        F.expr(f"at - (shard * {whole} + {shards - 1}) div {shards}").alias("slot"),
    )


def write_shards(docs: DataFrame, places: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write whole documents into one folder for each shard, in slot order, given their unique ids' places.

    Columns of ``docs`` named shard or slot are replaced by the places, as in ``interleaved``.
    """
    joined = docs.drop("shard", "slot").join(places.select(id_col, "shard", "slot"), id_col)
    joined.repartition("shard", F.floor(F.col("slot") / RANGE_ROWS)).sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard"
    ).parquet(path)

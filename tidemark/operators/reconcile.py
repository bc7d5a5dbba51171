"""Two extracts of one table: rows that one has more often than the other, and what changed key by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.plans.staging import staged

LEFT, RIGHT = "left", "right"
_NESTED = (T.ArrayType, T.StructType)


def _null_safe(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Each column and whether it is null: a hash passes over nulls, so (null, 1) would equal (1, null)."""
    out = []
    for c in columns:
        x = F.col(f"`{c}`")
        if isinstance(df.schema[c].dataType, _NESTED):
            x = F.to_json(F.struct(x), {"ignoreNullFields": "false"})
        out += [F.col(f"`{c}`").isNull(), x]
    return out


def surplus(left: DataFrame, right: DataFrame) -> DataFrame:
    """The multiset difference both ways: rows with ``surplus_side`` and ``surplus_rows``, how often that side has them more.

    Both frames need the same columns and types, in any order; map columns can't be compared.  Nulls equal nulls.  First
    only 128-bit row hashes are shuffled and counted, 24 bytes a row; then the rows whose hashes are out of balance are
    taken and counted once more as whole rows.  Equal extracts never shuffle a row.  Both counts combine before the
    shuffle, so a row that makes up most of a table is one row of each task.
    """
    columns = left.columns
    if sorted(columns) != sorted(right.columns):
        raise ValueError(f"columns differ: {sorted(set(columns) ^ set(right.columns))}")
    if clash := {"surplus_side", "surplus_rows", "__n", "__h", "__g"} & set(columns):
        raise ValueError(f"columns named as output columns: {sorted(clash)}")
    for c in columns:
        if left.schema[c].dataType != right.schema[c].dataType:
            raise ValueError(f"types of {c} differ")
        if isinstance(left.schema[c].dataType, T.MapType):
            raise ValueError(f"{c} is a map")
    quoted = [F.col(f"`{c}`") for c in columns]

    def side(df: DataFrame, n: int) -> DataFrame:
        parts = _null_safe(df, columns)
        hashes = [F.xxhash64(*parts).alias("__h"), F.xxhash64(F.lit(n * n), *parts).alias("__g")]
        return df.select(*quoted, *hashes, F.lit(n).cast("long").alias("__n"))

    both = side(left, 1).unionByName(side(right, -1))
    uneven = both.groupBy("__h", "__g").agg(F.sum("__n").alias("net")).where("net <> 0").select("__h", "__g")
    found = both.join(staged(uneven, "reconcile-uneven"), ["__h", "__g"], "left_semi")
    net = found.groupBy(*quoted).agg(F.sum("__n").alias("__n")).where("__n <> 0")
    return net.select(*quoted, F.when(F.col("__n") > 0, LEFT).otherwise(RIGHT).alias("surplus_side"), F.abs("__n").alias("surplus_rows"))


def key_changes(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each key whose rows differ: ``status``, rows on each side, and the names of the changed columns.

    ``removed``: only the left extract has rows more; ``added``: only the right one; ``changed``: both have.  A key that
    merely has more copies of a row is removed or added by that copy.  ``changed_columns`` is comma-joined, in the
    left frame's order, where each side has one distinct row; null otherwise, as rows then don't pair up.  Null keys are a key.
    """
    others = [c for c in left.columns if c not in keys]
    if clash := {"status", "rows_left", "rows_right", "changed_columns"} & set(keys):
        raise ValueError(f"keys named as output columns: {sorted(clash)}")
    rows = surplus(left, right)
    on_left, on_right = F.col("surplus_side") == LEFT, F.col("surplus_side") == RIGHT
    sign = F.when(on_left, F.lit(1)).otherwise(F.lit(-1))
    digests = []
    for i, c in enumerate(others):
        # Signed hashes of one row a side cancel exactly where the values are equal.
        value = F.xxhash64(*_null_safe(left, [c])).cast("decimal(20,0)")
        digests.append(F.sum(value * sign).alias(f"__d{i}"))
    per_key = rows.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(
        F.sum(F.when(on_left, F.col("surplus_rows")).otherwise(0)).alias("rows_left"),
        F.sum(F.when(on_right, F.col("surplus_rows")).otherwise(0)).alias("rows_right"),
        F.count_if(on_left).alias("__l"), F.count_if(on_right).alias("__r"), *digests,
    )
    status = F.when(F.col("__r") == 0, "removed").when(F.col("__l") == 0, "added").otherwise("changed")
    named = F.concat_ws(",", *[F.when(F.col(f"__d{i}") != 0, c) for i, c in enumerate(others)])
    single = (F.col("__l") == 1) & (F.col("__r") == 1)
    return per_key.select(
        *[F.col(f"`{k}`") for k in keys], status.alias("status"), "rows_left", "rows_right", F.when(single, named).alias("changed_columns")
    )


def change_summary(changes: DataFrame) -> DataFrame:
    """Keys and rows by status."""
    return changes.groupBy("status").agg(
        F.count(F.lit(1)).alias("keys"), F.sum("rows_left").alias("rows_left"), F.sum("rows_right").alias("rows_right")
    )

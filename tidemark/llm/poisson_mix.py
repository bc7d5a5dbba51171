"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.staging import staged

SEED = 11
#: Without given weights a source weighs its share of characters to this power, which lifts small sources.
POWER = 0.7
#: The mix has so many times the characters of the input, in the mean.
EPOCHS = 1.0


def _number(text: Column) -> Column:
    """52 bits of the MD5 sum of a text, as a long."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def rates(docs: DataFrame, weights: dict[str, float] | None, power: float, epochs: float, by: str, text_col: str) -> DataFrame:
    """(source, rate, cdf): the mean number of copies of a document and the Poisson distribution with that mean.

    The distribution is listed, in logarithms for large means, until what is left is beyond a double's precision.
    """
    chars = F.sum(F.length(F.col(f"`{text_col}`").cast("string")))
    sizes = docs.groupBy(F.col(f"`{by}`").alias("source")).agg(F.coalesce(chars, F.lit(0)).cast("double").alias("chars"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.when(F.col("chars") > 0, F.pow("chars", F.lit(power))).otherwise(0.0))
    else:
        if any(w < 0 for w in weights.values()):
            raise ValueError("weights must not be negative")
        given = [x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))]
        chosen = F.create_map(*given)[F.col("source").cast("string")] if given else F.lit(0.0)
        sizes = sizes.withColumn("weight", F.coalesce(chosen, F.lit(0.0)))
        sizes = sizes.withColumn("weight", F.when(F.col("chars") > 0, F.col("weight")).otherwise(0.0))
    whole = sizes.agg(F.sum("chars").alias("chars"), F.sum("weight").alias("weight")).first()
    if not whole["weight"]:
        return sizes.select("source", F.lit(0.0).alias("rate"), F.array(F.lit(2.0)).alias("cdf"))
    rate = F.when(F.col("weight") > 0, F.col("weight") / whole["weight"] * whole["chars"] * epochs / F.col("chars"))
    rated = sizes.withColumn("rate", F.coalesce(rate, F.lit(0.0)))
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    log_p = F.transform(F.sequence(F.lit(1), last), lambda k: F.ln("rate") - F.ln(k.cast("double")))
    start = F.struct((-F.col("rate")).alias("log_p"), F.array(F.exp(-F.col("rate"))).alias("cdf"))

    def step(state, gain):
        further = state["log_p"] + gain
        return F.struct(further.alias("log_p"), F.concat(state["cdf"], F.array(F.element_at(state["cdf"], -1) + F.exp(further))).alias("cdf"))

    cdf = F.aggregate(log_p, start, step)["cdf"]
    return rated.select("source", "rate", F.when(F.col("rate") > 0, cdf).otherwise(F.array(F.lit(2.0))).alias("cdf"))


def poisson_mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    power: float = POWER,
    epochs: float = EPOCHS,
    seed: int = SEED,
    by: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` repeated so that sources have the target shares of characters, in one global random order.

    A document has as many copies as the Poisson distribution with its source's rate gives for a number hashed from the
    seed and its id, so any part can be computed again anywhere with the same result.  Adds ``copy`` (from 0) and
    ``mix_key``; rows are sorted by mix_key across partitions, which is the shuffle.  Columns of those names are replaced.

    A null source is a source of its own, of weight 0 where weights are given.  Sources not in ``weights``, and sources
    without a character, have no copies.  A row without an id is hashed by its text; equal rows have equal counts.
    An empty table gives an empty result.  The rate table joins by Spark's own size check.
    """
    rated = rates(docs, weights, power, epochs, by, text_col)
    # Written, so that Spark knows its size and the texts needn't be dealt out by source to meet it.
    rated = staged(rated.select(F.struct("source", "rate", "cdf").alias("mix")), "mix-rates")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    source, own = F.col("doc").getField(by), F.col("doc").getField(id_col).cast("string")
    joined = packed.join(rated, source.eqNullSafe(F.col("mix.source")))
    name = F.coalesce(own, F.md5(F.coalesce(F.col("doc").getField(text_col).cast("string"), F.lit(""))))
    number = _number(F.concat(F.lit(f"{seed}:"), name)).cast("double") / float(1 << 52)
    counted = joined.select("doc", name.alias("name"), F.size(F.filter("mix.cdf", lambda c: c <= number)).alias("copies"))
    copied = counted.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    key = _number(F.concat(F.lit(f"{seed}:"), F.col("name"), F.lit(":"), F.col("copy").cast("string")))
    kept = [c for c in docs.columns if c not in ("copy", "mix_key")]
    return copied.select(*[F.col("doc").getField(c).alias(c) for c in kept], "copy", key.alias("mix_key")).orderBy("mix_key", "copy")


MIX_SQL = f"""
WITH sizes AS (
  SELECT source, coalesce(sum(length(text)), 0)::DOUBLE AS chars FROM documents GROUP BY source
), weighed AS (
  SELECT *, CASE WHEN chars > 0 THEN pow(chars, {POWER}) ELSE 0 END AS weight FROM sizes
), rated AS (
  SELECT source, CASE WHEN chars > 0
    THEN weight / sum(weight) OVER () * sum(chars) OVER () * {EPOCHS} / chars ELSE 0 END AS rate FROM weighed
), terms AS (
  SELECT source, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 31)::BIGINT)) AS k, rate FROM rated WHERE rate > 0
), cdf AS (
  SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c FROM terms
), seeded AS (
  SELECT doc_id, source, ('0x' || substr(md5('{SEED}:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents
), counted AS (
  SELECT s.doc_id, s.source, count(*) AS copies FROM seeded s JOIN cdf ON s.source IS NOT DISTINCT FROM cdf.source AND cdf.c <= s.u
  GROUP BY ALL
), copied AS (
  SELECT doc_id, source, unnest(range(0, copies))::INT AS copy FROM counted
)
SELECT doc_id, source, copy, ('0x' || substr(md5('{SEED}:' || doc_id || ':' || copy), 1, 13))::BIGINT AS mix_key FROM copied
"""

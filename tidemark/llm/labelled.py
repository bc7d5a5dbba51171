"""Bounded samples of labelled documents, and the documents held out from all learning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Whether a document is held out: CRC-32 of its id as text, modulo 4, is 2.  A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: dict[int, int], longest: int, seed: int) -> DataFrame:
    """(doc_id, text, y) of at most ``per_class[y]`` labelled documents of each class, those with the smallest hashes.

    Held-out ids and null labels aren't taken; texts of over ``longest`` characters aren't either, so that what training
    holds is bounded, and others are taken instead.  An id labelled both ways isn't learnt from.  An id counts once, however
    often it is labelled or stands in ``docs``; of several texts the one with the smallest hash is taken.  The ids taken are
    few, a stated number, and so are broadcast to find their texts.
    """
    texts = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.where(F.char_length("text") <= longest)
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(~held_out(F.col("doc_id"))).where("y IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").drop("other")
    known = known.join(texts.select("doc_id"), "doc_id", "left_semi")
    key = F.xxhash64(F.lit(seed), "doc_id")
    parts = [known.where(F.col("y") == y).orderBy(key, "doc_id").limit(n) for y, n in per_class.items()]
    taken = parts[0]
    for part in parts[1:]:
        taken = taken.union(part)
    found = texts.join(F.broadcast(taken), "doc_id").groupBy("doc_id", "y")
    return found.agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text")).select("doc_id", "text", "y")

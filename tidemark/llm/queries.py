"""The registered queries of this subpackage and the SQL that some are compared with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import auction_repair, blob_ledger, factorisation, gamma_sampling, interleave, jaccard_join, line_rules, packing, poisson_mix, reduced_alphabet, toxicity, two_stage_suffixes, warc
from tidemark.plans.staging import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql:
            ORACLE[name] = sql
        return build

    return add


def _joined(spans, wanted: str | None = None):
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


@query("op1_warc")
def _op1(spark: SparkSession, directory: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_warc(table(spark, directory, "pages"), path)
    read = warc.read_warc(spark, path, blocks=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


@query("op2_factorisation_machine")
def _op2(spark: SparkSession, directory: str) -> DataFrame:
    return factorisation.quality(table(spark, directory, "documents"), table(spark, directory, "labels"))


@query("op3_interleaved_shards")
def _op3(spark: SparkSession, directory: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = table(spark, directory, "documents").select(
        "doc_id", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    placed = interleave.interleaved(slim, by="source", order=["doc_id", "text_crc32"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )


@query("op4_blob_ledger")
def _op4(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents").select("doc_id", "text")
    found = blob_ledger.scanned(docs, blob_ledger.BlobLedger(spark))
    spans = F.col("secret_spans")
    count = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined(spans), 256).alias("base_sha256"), _joined(spans).alias("spans")
    )


@query("op5_best_two_fit")
def _op5(spark: SparkSession, directory: str) -> DataFrame:
    return packing.packed_documents(table(spark, directory, "documents"))


@query("op6_gamma_sampling")
def _op6(spark: SparkSession, directory: str) -> DataFrame:
    return gamma_sampling.fingerprints(table(spark, directory, "documents"))


@query("op7_toxicity")
def _op7(spark: SparkSession, directory: str) -> DataFrame:
    return toxicity.toxicity(table(spark, directory, "documents"), table(spark, directory, "labels"))


@query("op8_jaccard_join")
def _op8(spark: SparkSession, directory: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, directory, "documents"))


@query("op9_poisson_mix", poisson_mix.MIX_SQL)
def _op9(spark: SparkSession, directory: str) -> DataFrame:
    mixed = poisson_mix.poisson_mix(table(spark, directory, "documents"))
    return mixed.select("doc_id", "source", "copy", "mix_key")


@query("op10_line_rules", line_rules.RULES_SQL)
def _op10(spark: SparkSession, directory: str) -> DataFrame:
    found = line_rules.line_first(table(spark, directory, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op12_auction_repair")
def _op12(spark: SparkSession, directory: str) -> DataFrame:
    damaged = auction_repair.damaged(table(spark, directory, "conversations"))
    return auction_repair.repaired_digests(damaged, copies="copies")


@query("op11_reduced_alphabet")
def _op11(spark: SparkSession, directory: str) -> DataFrame:
    return reduced_alphabet.spelling_variants(table(spark, directory, "documents"), reduced_alphabet.NOISE)


@query("op13_two_stage_sorting")
def _op13(spark: SparkSession, directory: str) -> DataFrame:
    found = two_stage_suffixes.without_repeats(table(spark, directory, "documents").select("doc_id", "text"))
    length = F.transform("spans", lambda x: x["end"] - x["start"])
    removed = F.aggregate(length, F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )

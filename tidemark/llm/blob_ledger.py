"""Secret scans of texts with an incremental ledger of content-addressed blobs."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidemark.plans.staging import shared_dir


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a Java pattern, the version under which its results are kept, and a bound on a part's length.

    ``hint`` is a cheaper pattern that every match contains; a blob without it isn't searched further.
    """

    kind: str
    pattern: str
    version: int = 1
    value: str | None = None
    shortest: int = 0
    hint: str | None = None


#: The kinds in the order in which equal starts are listed.
RULES = (
    Rule(
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
        value=r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""",
        shortest=6,
        hint=r"(?i:password|passwd|secret|token|api_?key)",
    ),
    Rule("access", r"AKIA[A-Z0-9]+", shortest=20, hint=r"AKIA[A-Z0-9]{16}"),
    Rule("hex", r"[0-9a-f]{24,}", shortest=24, hint=r"[0-9a-f]{24}"),
)
_SPANS = "array<struct<start:long,rank:int,kind:string,end:long>>"


def rule_spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans, in code points, of the rule's leftmost non-overlapping matches that are long enough.

    Each match is taken together with the text between it and the match before, so that running lengths give its place.
    """
    joined = rf"\G((?s:.*?))({rule.pattern})"
    before, found = (F.regexp_extract_all(text, F.lit(joined), F.lit(i)) for i in (1, 2))
    steps = F.arrays_zip(before.alias("before"), found.alias("found"))

    def step(state, x):
        start = state["at"] + F.char_length(x["before"])
        end = start + F.char_length(x["found"])
        value = F.regexp_replace(x["found"], rule.value, "") if rule.value else x["found"]
        span = F.struct(
            start.cast("long").alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.cast("long").alias("end")
        )
        kept = F.when(F.char_length(value) >= rule.shortest, F.array(span)).otherwise(F.array().cast(_SPANS))
        return F.struct(end.cast("long").alias("at"), F.concat(state["spans"], kept).alias("spans"))

    nothing = F.array().cast(_SPANS)
    start = F.struct(F.lit(0).cast("long").alias("at"), nothing.alias("spans"))
    spans = F.aggregate(steps, start, step)["spans"]
    return F.when(text.rlike(rule.hint), spans).otherwise(nothing) if rule.hint else spans


class BlobLedger:
    """A Parquet table (blob, kind, version, spans) of what has been scanned, in a folder that all executors reach.

    A blob is named by the SHA-256 of its UTF-8 text.  ``scan`` searches, for each rule version, only blobs that the
    ledger doesn't have under it, each once however many paths and historical versions hold it, and appends the results
    with Spark's own commit; a scan that failed midway has appended nothing and is simply run again.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/blob-ledger-{uuid.uuid4().hex}"

    _SCHEMA = f"blob string, spans {_SPANS}, kind string, version int"

    def entries(self) -> DataFrame:
        try:
            return self.spark.read.schema(self._SCHEMA).parquet(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self._SCHEMA)

    @staticmethod
    def blob(text: Column) -> Column:
        return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)

    def scan(self, texts: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> None:
        """Search the unseen blobs among ``texts``; null is the empty text.

        Texts are reduced to one for each blob before and after the shuffle, so a text with a third of all rows
        reaches its task once from each part of the input.
        """
        text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
        blobs = texts.select(self.blob(text).alias("blob"), text.alias("text")).dropDuplicates(["blob"])
        names = [F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules]
        seen = (
            self.entries()
            .where(F.struct("kind", "version").isin(*names))
            .groupBy("blob")
            .agg(F.collect_set(F.concat_ws(":", "kind", "version")).alias("seen"))  # at most as many as there are rules
        )
        unseen = blobs.join(seen, "blob", "left").select("blob", "text", F.coalesce("seen", F.array().cast("array<string>")).alias("seen"))
        results = []
        for rank, rule in enumerate(rules):
            fresh = ~F.array_contains("seen", f"{rule.kind}:{rule.version}")
            results.append(
                F.when(
                    fresh,
                    F.struct(
                        rule_spans(F.col("text"), rule, rank).alias("spans"),
                        F.lit(rule.kind).alias("kind"),
                        F.lit(rule.version).alias("version"),
                    ),
                )
            )
        found = unseen.select("blob", F.explode(F.array(*results)).alias("x")).where("x IS NOT NULL").select("blob", "x.*")
        found.write.mode("append").parquet(self.path)

    def spans(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(blob, spans): all spans of each blob that has any, by start and then by the rules' order."""
        names = [F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules]
        hits = self.entries().where(F.size("spans") > 0).where(F.struct("kind", "version").isin(*names))
        gathered = hits.groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
        return gathered.select("blob", F.array_sort("spans").alias("spans"))


def scanned(docs: DataFrame, ledger: BlobLedger, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``secret_spans``, an array of (start, rank, kind, end) by start, empty where nothing is found.

    Every row (path, or version of a path) gets the findings of its blob.  Null and empty texts have none, repeated rows
    get the same, other columns pass; a column named secret_spans is replaced.  Blobs with findings join by their
    name; adaptive execution splits one that many rows have.
    """
    ledger.scan(docs, text_col, rules)
    hits = ledger.spans(rules).select(F.struct("blob", "spans").alias("hit"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), BlobLedger.blob(F.col(f"`{text_col}`")).alias("own_blob"))
    joined = packed.join(hits, F.col("own_blob") == F.col("hit.blob"), "left")
    kept = [c for c in docs.columns if c != "secret_spans"]
    return joined.select(
        *[F.col("doc").getField(c).alias(c) for c in kept],
        F.coalesce("hit.spans", F.array().cast(_SPANS)).alias("secret_spans"),
    )


def masked(docs: DataFrame, ledger: BlobLedger, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span replaced by ``mask``; overlapping spans are replaced as one.  Nothing else changes."""
    found = scanned(docs, ledger, text_col)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))

    def step(state, span):
        start, end = span["start"], span["end"]
        fresh = start >= state["at"]
        before = F.substring(text, (state["at"] + 1).cast("int"), F.greatest(start - state["at"], F.lit(0)).cast("int"))
        return F.struct(
            F.greatest(state["at"], end).alias("at"),
            F.when(fresh, F.concat(state["out"], before, F.lit(mask))).otherwise(state["out"]).alias("out"),
        )

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    finish = lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.char_length(text)))
    replaced = F.aggregate("secret_spans", begin, step, finish)
    new = F.when(F.size("secret_spans") > 0, replaced).otherwise(F.col(f"`{text_col}`")).alias(text_col)
    return found.select(*[new if c == text_col else F.col(f"`{c}`") for c in docs.columns])

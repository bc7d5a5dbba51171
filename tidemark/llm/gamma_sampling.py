"""Document fingerprints by consistent weighted sampling with gamma variates.

A text is its words, each weighted by how often it occurs.  For every sample and word, two gamma variates and a
uniform one, all hashed from the word, decide at which step below its weight the word is sampled and how
early.  The earliest word and its step are the sample.  Two texts have the same sample with a probability equal to
the generalised Jaccard similarity of their weights, the sum of the lesser weights over the sum of the greater.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.line_rules import SPACE
from tidemark.plans.staging import staged

SAMPLES = 32
SEED = 5
#: Ids are put in order in ranges of about so many rows; texts are grouped in parts of about so many characters.
RANGE_ROWS = 1 << 17
PART_CHARS = 8_000_000


def _sample(k: int) -> Column:
    """Of one word (hash ``term``, logarithm of its weight ``lw``): how early it comes in sample ``k``, and its mark.

    Both are in one long, earliness in the upper 47 bits and a 16-bit mark of (word, step) below, so that a plain
    minimum over a text's words, computed in generated code, gives the sample.
    """
    a, b, c = (f"xxhash64(term, {3 * k + i}L)" for i in range(3))

    def gamma(h: str) -> str:  # of shape 2: minus the logarithm of the product of two uniform numbers
        upper, lower = f"shiftrightunsigned({h}, 32)", f"({h} & 4294967295L)"
        return f"(-ln(({upper} + 0.5D) * ({lower} + 0.5D) / 18446744073709551616D))"

    r, beta = gamma(a), f"(shiftrightunsigned({c}, 11) / 9007199254740992D)"
    step = f"floor(lw / {r} + {beta})"
    early = f"(ln({gamma(b)}) - {r} * ({step} - {beta} + 1D))"
    return F.expr(
        f"shiftleft(cast(({early} + 4096D) * 17179869184D as long), 16) | (xxhash64(term, {step}) & 65535L)"
    )


def _signatures(terms: DataFrame, keys: list[str], samples: int) -> DataFrame:
    """Signature (four hexadecimal digits a sample) of each text, given rows (keys, term, lw) of its words.

    Rows of a text must be in one partition already; ``raw`` is its greatest term, for callers that pass numbers.
    """
    sampled = terms.groupBy(*keys).agg(*[F.min(_sample(k)).alias(f"s{k}") for k in range(samples)], F.max("term").alias("raw"))
    marks = [F.lpad(F.hex(F.col(f"s{k}").bitwiseAND(65535)), 4, "0") for k in range(samples)]
    return sampled.select(*keys, F.concat(*marks).alias("signature"), "raw")


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of samples in which two signatures agree, an estimate of generalised Jaccard similarity."""
    same = [(F.substring(a, 4 * k + 1, 4) == F.substring(b, 4 * k + 1, 4)).cast("int") for k in range(samples)]
    total = same[0]
    for x in same[1:]:
        total = total + x
    return total / F.lit(float(samples))


def successors(ids: DataFrame) -> DataFrame:
    """(doc_id, n_chars, next_id) for distinct ids: the next larger id, after the largest the smallest.

    Ids are dealt out by range and written; only the first of each range is looked at by the range before.
    """
    ranges = -(-ids.count() // RANGE_ROWS) or 1
    dealt = staged(ids.repartitionByRange(ranges, "doc_id").withColumn("part", F.spark_partition_id()), "gamma-ids")
    firsts = dealt.groupBy("part").agg(F.min("doc_id").alias("first"))
    every = Window.orderBy("part")  # one row for each range
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(every), F.first("first").over(every)).alias("after"))
    following = F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    return dealt.join(firsts, "part").select("doc_id", "n_chars", F.coalesce(following, "after").alias("next_id"))


def _signed(both: DataFrame, keys: list[str], samples: int) -> DataFrame:
    """Fingerprints of ``text`` and of its edited form, which ends in ``head``; rows lie together by one of the keys already."""
    n = F.char_length("text")
    kept = F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 2) as int))")
    head = F.expr("substring(head, 1, cast(floor(char_length(text) / 2) as int))")
    both = both.select(*keys, "text", F.concat(kept, F.coalesce(head, F.lit(""))).alias("edited"), n.alias("n"))
    both = both.withColumn("sha", F.sha2(F.col("edited").cast("binary"), 256))
    # Each text is split into words; the length and the sum's four parts travel as numbers among them.
    numbers = [F.col("n").cast("string")] + [F.conv(F.substring("sha", 16 * i + 1, 16), 16, -10) for i in range(4)]
    bodies = F.array(*[F.struct(F.lit(i).alias("what"), c.alias("body")) for i, c in enumerate([F.col("text"), F.col("edited"), *numbers])])
    words = both.select(*keys, F.explode(bodies).alias("x")).select(*keys, "x.what", F.explode(F.split("x.body", SPACE)).alias("word"))
    term = F.when(F.col("what") >= 2, F.col("word").try_cast("long")).otherwise(F.xxhash64(F.lit(SEED), "word"))
    counted = words.select(*keys, "what", term.alias("term")).groupBy(*keys, "what", "term").agg(
        F.ln(F.count(F.lit(1)).cast("double")).alias("lw")
    )
    signed = _signatures(counted, [*keys, "what"], samples)
    of = lambda i, c: F.max(F.when(F.col("what") == i, F.col(c)))
    return signed.groupBy(*keys).agg(
        of(0, "signature").alias("fingerprint"),
        of(1, "signature").alias("edited_fingerprint"),
        of(2, "raw").alias("n_chars"),
        F.concat(*[F.lpad(F.hex(of(3 + i, "raw")), 16, "0") for i in range(4)]).alias("edited_sha256"),
    )


def fingerprints(docs: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row.

    The edited text has its last floor(n_chars / 2) code points replaced by as many of the beginning of the next
    document, by ascending id, or all it has.  A null text is empty; an empty text has one empty word, so that it is
    alike to other empty texts only.  White space before the first word counts as an empty word.

    Rows without an id have no next document: their edited text lacks its second half, and near_next is null.
    Rows that share an id share the next document; as anyone's next document, the least of their beginnings counts.
    Other columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    whole = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    own, nameless = whole.where("doc_id IS NOT NULL"), whole.where("doc_id IS NULL")
    ids = own.groupBy("doc_id").agg(F.max(F.char_length("text")).alias("n_chars"))
    after = staged(successors(staged(ids, "gamma-lengths")), "gamma-next")
    chars = after.agg(F.sum("n_chars")).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // PART_CHARS))

    # Whole texts are shuffled once, by id; the beginnings go on to the documents before.  Both reads share the shuffle only if
    # their plans are equal.  Names other than the input's keep them so: an alias of the same name may be dropped from one of them.
    key, body = f"{id_col}_dealt", f"{text_col}_dealt"
    dealt = own.select(F.col("doc_id").alias(key), F.col("text").alias(body)).repartition(parts, key)
    heads = dealt.join(after.select(F.col("next_id").alias(key), F.col("doc_id").alias("before"), "n_chars"), key)
    heads = heads.select("before", F.substring(body, F.lit(1), F.floor(F.col("n_chars") / 2).cast("int")).alias("head"))
    heads = heads.repartition(parts, "before").groupBy("before").agg(F.min("head").alias("head"))
    both = dealt.join(heads, dealt[key] == heads["before"], "left").withColumnRenamed(body, "text")
    # Rows without an id would share one key; each goes by a number of its own, which only meets itself.
    chars = nameless.agg(F.sum(F.char_length("text"))).first()[0] or 0
    alone = nameless.withColumn("row", F.monotonically_increasing_id()).withColumn("head", F.lit(""))
    alone = alone.repartition(max(parts, -(-chars // PART_CHARS)), "row")
    signed = _signed(both.withColumn("row", F.monotonically_increasing_id()), [key, "row"], samples).withColumnRenamed(key, "doc_id")
    signed = signed.unionByName(_signed(alone, ["row"], samples).withColumn("doc_id", F.lit(None).cast("long")))
    signed = staged(signed.drop("row"), "gamma-signed")
    nexts = after.select("doc_id", "next_id").join(
        signed.groupBy(F.col("doc_id").alias("next_id")).agg(F.min("fingerprint").alias("next_fingerprint")), "next_id"
    )
    joined = signed.join(nexts.select("doc_id", "next_fingerprint"), "doc_id", "left")
    return joined.select(
        "doc_id",
        "n_chars",
        F.lower("edited_sha256").alias("edited_sha256"),
        F.lower("fingerprint").alias("fingerprint"),
        F.lower("edited_fingerprint").alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint"), samples).alias("near_next"),
    )

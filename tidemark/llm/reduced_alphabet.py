"""Spelling variant grouping: words one edit apart, found by way of a reduced alphabet.

Each letter is hashed to one of a few symbols.  Two words that are one edit apart have reduced words at most one edit
apart, so the full one-edit neighbourhood of each reduced word (every deletion, replacement and insertion over the
few symbols) meets the reduced word of every near word.  Neighbourhoods are generated once for each different reduced word and
joined with the reduced vocabulary; only pairs that meet are brought back to words, and those are verified on the
original strings.

A neighbour is a 64-bit number made from running sums over the reduced word, so a neighbourhood takes space in
proportion to the word's length, not its square.  Chance meetings of numbers cost a verification and change nothing.
The number of symbols follows the eighth root of the vocabulary's size: with fewer, unrelated words meet, with more the
neighbourhoods grow.  Any number gives the same result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.wordhash import mix
from tidemark.plans.staging import staged

MIN_CHARS = 6
MIN_COUNT = 5
#: A form is at least so many times as frequent as the word.
TIMES = 5
#: One in so many occurrences of a word loses a letter before counting, in the registered query.
NOISE = 199
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_END = re.compile("[^A-Za-zÀ-ÿ]")
_CHUNK = 1 << 20
_HELD = 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
U = np.uint64


# Words and how often they occur ----------------------------------------------------------------------------------


def _runs(text: str) -> Counter:
    """Runs of letters, A-Z lower-cased, and their counts; a long text is taken in parts that end between runs."""
    found: Counter = Counter()
    start = 0
    while start < len(text):
        end = len(text)
        if end - start > _CHUNK:
            cut = _END.search(text, start + _CHUNK)
            end = cut.start() if cut else end
        found.update(_RUN.findall(text[start:end].encode().lower().decode()))
        start = end
    return found


def _counted(batches: Iterator[pa.RecordBatch], noise: int | None) -> Iterator[pa.RecordBatch]:
    counts: defaultdict[str, int] = defaultdict(int)

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for run, n in _runs(text.as_py() or "").items():
                if len(run) < MIN_CHARS:
                    continue
                if noise is not None:
                    h = zlib.crc32(run.encode(), before)
                    if h % noise == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < MIN_CHARS:
                            continue
                counts[run] += n
            if len(counts) > _HELD:
                yield flush()
    yield flush()


def vocabulary(docs: DataFrame, noise: int | None = None) -> DataFrame:
    """(word, n): runs of letters of at least MIN_CHARS code points that occur at least MIN_COUNT times in all texts.

    With ``noise``, an occurrence whose CRC-32 of ``doc_id:run`` it divides loses one letter first; a null id is empty there.
    Counts are combined in each task before the shuffle, so a frequent word is a row for each batch at most.
    """
    slim = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    partial_counts = slim.mapInArrow(partial(_counted, noise=noise), "word string, n long")
    return partial_counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


# Reduced words and their neighbourhoods ----------------------------------------------------------------------------


def letter_symbols(symbols: int) -> np.ndarray:
    """The symbol of each code point up to 255."""
    return (mix(np.arange(256, dtype=U)) % U(symbols)).astype(np.uint8)


def _sums(terms: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros((len(terms), 1), dtype=U), np.cumsum(terms, axis=1, dtype=U)], axis=1)


def neighbourhoods(reduced: np.ndarray, symbols: int) -> np.ndarray:
    """Numbers of all strings within one edit of each row of symbols, the row itself included; rows of one length.

    A string's number is the sum of value(symbol) * base**place, mixed; an edit shifts the places behind it by one.
    """
    n = reduced.shape[1]
    value = mix(np.arange(1, symbols + 1, dtype=U) * _BASE)
    power = np.cumprod(np.concatenate([np.ones(1, U), np.full(n + 1, _BASE, U)]), dtype=U)
    own = value[reduced]
    here, later = _sums(own * power[:n]), _sums(own * power[1 : n + 1])
    earlier = _sums(np.concatenate([np.zeros((len(own), 1), U), own[:, 1:] * power[: n - 1]], axis=1))
    whole = here[:, -1:]
    deleted = here[:, :n] + earlier[:, -1:] - earlier[:, 1:]
    placed = value[None, :, None] * power[None, None, : n + 1]
    replaced = (whole - own * power[:n])[:, None, :] + placed[:, :, :n]
    inserted = (here + later[:, -1:] - later)[:, None, :] + placed
    return mix(np.concatenate([deleted, replaced.reshape(len(own), -1), inserted.reshape(len(own), -1)], axis=1))


def _numbers(reduced: np.ndarray, symbols: int) -> np.ndarray:
    """The number of each row itself."""
    n = reduced.shape[1]
    value = mix(np.arange(1, symbols + 1, dtype=U) * _BASE)
    power = np.cumprod(np.concatenate([np.ones(1, U), np.full(n, _BASE, U)]), dtype=U)
    return mix((value[reduced] * power[:n]).sum(axis=1, dtype=U))


def _by_length(words: list[bytes], at_once: int) -> Iterator[np.ndarray]:
    """Places of words of one length, few enough that their neighbourhoods stay small."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    for n in np.unique(lengths).tolist():
        of = np.flatnonzero(lengths == n)
        step = max(1, at_once // (n + 1))
        yield from (of[i : i + step] for i in range(0, len(of), step))


def _matrix(words: list[bytes], places: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(words[i] for i in places.tolist()), dtype=np.uint8).reshape(len(places), -1)


def _reduced(batches: Iterator[pa.RecordBatch], symbols: int) -> Iterator[pa.RecordBatch]:
    table = letter_symbols(symbols)
    for batch in batches:
        words = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
        key = np.zeros(len(words), dtype=U)
        reduced: list[bytes] = [b""] * len(words)
        for places in _by_length(words, 1 << 20):
            rows = table[_matrix(words, places)]
            key[places] = _numbers(rows, symbols)
            for i, row in zip(places.tolist(), rows, strict=True):
                reduced[i] = row.tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column("word"), batch.column("n"), pa.array(key.view(np.int64)), pa.array(reduced, pa.binary())], ["word", "n", "key", "reduced"]
        )


def _near_keys(batches: Iterator[pa.RecordBatch], symbols: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, keys = batch.column("reduced").to_pylist(), batch.column("key").to_numpy()
        for places in _by_length(words, 1 << 15):
            near = np.sort(neighbourhoods(_matrix(words, places), symbols).view(np.int64), axis=1)
            fresh = np.ones(near.shape, dtype=bool)
            fresh[:, 1:] = near[:, 1:] != near[:, :-1]
            key = np.repeat(keys[places], fresh.sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(near[fresh])], ["key", "near"])


def near_words(words: DataFrame, symbols: int | None = None) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of words exactly one inserted, deleted or replaced code point apart.

    ``words`` has distinct words of code points up to 255, and their counts.  Runs jobs at once.
    """
    held = staged(words.select("word", "n"), "variants-words")
    if symbols is None:
        symbols = min(16, max(4, math.ceil(held.count() ** (1 / 8))))
    schema = "word string, n long, key long, reduced binary"
    keyed = staged(held.mapInArrow(partial(_reduced, symbols=symbols), schema), "variants-reduced")
    # Written, so that Spark knows their size and broadcasts them only where that is small.
    classes = staged(keyed.select("key", "reduced").distinct(), "variants-classes")
    generated = classes.mapInArrow(partial(_near_keys, symbols=symbols), "key long, near long")
    met = generated.join(classes.select(F.col("key").alias("near")), "near", "left_semi").distinct()
    one = keyed.select("key", "word", "n")
    other = keyed.select(F.col("key").alias("near"), F.col("word").alias("near_word"), F.col("n").alias("near_n"))
    pairs = one.join(met, "key").join(other, "near")
    pairs = pairs.where(F.levenshtein("word", "near_word", 1) == 1)
    return pairs.select("word", "n", F.col("near_word").alias("near"), "near_n")


# Forms and roots -------------------------------------------------------------------------------------------------


def _roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root) of the words that have a form: forms are followed to the last, two steps, four steps, and so on.

    Each step multiplies the count by TIMES, so the longest chain is known from the largest count.
    """
    steps = max(1, math.ceil(math.log(max(most, TIMES), TIMES)))
    ahead = staged(forms.select("word", F.col("form").alias("root")), "variants-roots")
    for _ in range(math.ceil(math.log2(steps + 1))):
        further = ahead.select(F.col("word").alias("root"), F.col("root").alias("last"))
        ahead = staged(ahead.join(further, "root", "left").select("word", F.coalesce("last", "root").alias("root")), "variants-roots")
    return ahead


def variants(words: DataFrame, symbols: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each of ``words`` (word, n).

    A form is the near word of largest count, ties by code points, if it is TIMES as frequent; else form and form_n are
    null.  The root is the last word reached by following forms, the word itself if it has none.  No words give no rows.
    Runs jobs at once.
    """
    held = staged(words.select("word", "n"), "variants-vocabulary")
    pairs = near_words(held, symbols)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    near = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    likely = -F.col("best.less") >= TIMES * F.col("n")
    known = held.join(near, "word", "left").select(
        "word",
        F.when(likely, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(likely, -F.col("best.less")).alias("form_n"),
    )
    known = staged(known, "variants-known")
    most = known.agg(F.max("n")).head()[0] or 1
    roots = _roots(known.where("form IS NOT NULL"), most)
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, noise: int | None = None) -> DataFrame:
    """``variants`` of the vocabulary of whole texts.

    ``docs`` has doc_id and text; other columns are left aside.  Null texts have no words, repeated rows count as often as
    they occur, and an empty table gives no rows.
    """
    return variants(vocabulary(docs, noise))

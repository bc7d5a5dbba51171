"""Quality classifier: a factorisation machine over hashed words, structure statistics and the text's length.

Every feature has a weight and a short vector; a pair of features interacts by the product of their vectors.  The sum over
all pairs is half of (square of the sum less sum of the squares), coordinate by coordinate, so a text is scored in
time linear in its features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.labelled import held_out, training_rows
from tidemark.llm.wordhash import U, windows, word_blocks

#: Labelled documents from which training learns, at most, by class; none is longer than LONGEST characters.
TRAIN_ROWS = {1: 4000, 0: 2000}
LONGEST = 20_000
WORD_BITS = 15
RANK = 4
EPOCHS, RATE, DECAY, SEED = 30, 0.05, 1e-4, 9
THRESHOLD = 0.7
#: Runs of so many words count as repeated where they come again.
RUN = 3

#: Byte classes whose shares describe a text's structure.
_CLASSES = {
    "symbols": b"#*$%&|<>{}[]\\^~=+@_",
    "ends": b".!?",
    "stops": b",;:",
    "loud": b"!",
    "upper": bytes(range(65, 91)),
    "digits": bytes(range(48, 58)),
    "space": b" \t\r",
    "lines": b"\n",
    "wide": bytes(range(128, 256)),
}
_OF_CLASS = np.zeros((256, len(_CLASSES)))
for _i, _bytes in enumerate(_CLASSES.values()):
    _OF_CLASS[list(_bytes), _i] = 1
STATISTICS = [*_CLASSES, "log_chars", "log_words", "word_length", "distinct", "repeated", "same_lines", "line_length", "short", "long"]


def _statistics(text: str, words: np.ndarray) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    n, k = max(len(data), 1), max(len(words), 1)
    shares = np.bincount(data, minlength=256) @ _OF_CLASS / n
    runs = windows(words, RUN)
    lines = [x for x in text.split("\n") if x.strip()]
    rest = [
        np.log1p(len(text)),
        np.log1p(len(words)),
        len(text) / k,
        len(np.unique(words)) / k,
        1 - len(np.unique(runs)) / max(len(runs), 1) if len(runs) else 0.0,
        1 - len(set(lines)) / max(len(lines), 1) if lines else 0.0,
        np.log1p(len(text) / max(len(lines), 1)),
        float(len(words) < 50),
        float(len(words) > 5000),
    ]
    return np.concatenate((shares, rest))


def features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word buckets, their values, statistics) of each text; the values of a text have a sum of squares of 1."""
    at = 0
    for hashes, offsets in word_blocks(texts):
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            words = hashes[a:b]
            buckets, times = np.unique((words >> U(64 - WORD_BITS)).astype(np.int64), return_counts=True)
            yield buckets, np.sqrt(times / max(len(words), 1)), _statistics(texts[at] or "", words)
            at += 1


@dataclass
class Machine:
    """A factorisation machine: buckets of words first, then the statistics, which are put on one scale."""

    bias: float
    weights: np.ndarray
    vectors: np.ndarray
    middle: np.ndarray
    spread: np.ndarray

    def rows(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Features and values of each text."""
        own = (1 << WORD_BITS) + np.arange(len(self.middle))
        for buckets, values, statistics in features(texts):
            scaled = np.clip((statistics - self.middle) / self.spread, -4, 4)
            yield np.concatenate((buckets, own)), np.concatenate((values, scaled))

    def log_odds(self, at: np.ndarray, x: np.ndarray) -> float:
        by_x = self.vectors[at] * x[:, None]
        total = by_x.sum(axis=0)
        return float(self.bias + self.weights[at] @ x + 0.5 * (total @ total - (by_x * by_x).sum()))

    def score(self, texts: list[str | None]) -> np.ndarray:
        odds = np.array([self.log_odds(at, x) for at, x in self.rows(texts)])
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def train(texts: list[str], labels: list[int], share: float | None = None) -> Machine:
    """Logistic loss, AdaGrad steps over batches of documents; ``share`` is class 1's share where it isn't the sample's.

    A rare class may be taken more fully into the sample; the bias is then set back by the odds it gained.
    """
    draw = np.random.default_rng(SEED)
    y = np.array(labels, dtype=float)
    size = (1 << WORD_BITS) + len(STATISTICS)
    statistics = np.array([s for _, _, s in features(texts)]).reshape(-1, len(STATISTICS))
    middle = statistics.mean(axis=0) if len(y) else np.zeros(len(STATISTICS))
    spread = np.maximum(statistics.std(axis=0), 1e-3) if len(y) else np.ones(len(STATISTICS))
    if len(y):
        spread[np.ptp(statistics, axis=0) == 0] = np.inf  # nothing was learnt of what never varied: it counts as 0
    m = Machine(0.0, np.zeros(size), draw.normal(0, 0.02, (size, RANK)), middle, spread)
    if len(set(labels)) < 2:
        m.vectors[:] = 0
        m.bias = 5.0 if not len(y) or y[0] == 1 else -5.0
        return m
    rows = list(m.rows(texts))
    past_w, past_v, past_b = np.full(size, 1e-4), np.full((size, RANK), 1e-4), 1e-4
    for _ in range(EPOCHS):
        order = draw.permutation(len(rows))
        for batch in np.array_split(order, max(1, len(rows) // 64)):
            lengths = np.array([len(rows[i][0]) for i in batch])
            at, x = np.concatenate([rows[i][0] for i in batch]), np.concatenate([rows[i][1] for i in batch])
            owner, starts = np.repeat(np.arange(len(batch)), lengths), np.concatenate(([0], np.cumsum(lengths)[:-1]))
            by_x = m.vectors[at] * x[:, None]
            total = np.add.reduceat(by_x, starts)
            odds = m.bias + np.add.reduceat(m.weights[at] * x, starts)
            odds += 0.5 * ((total * total).sum(axis=1) - np.add.reduceat((by_x * by_x).sum(axis=1), starts))
            error = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - y[batch]) / len(batch)
            used, place = np.unique(at, return_inverse=True)
            g_w = np.bincount(place, error[owner] * x) + DECAY * m.weights[used]
            each = (error[owner] * x)[:, None] * (total[owner] - by_x)
            g_v = np.stack([np.bincount(place, each[:, f]) for f in range(RANK)], axis=1) + DECAY * m.vectors[used]
            past_w[used] += g_w * g_w
            past_v[used] += g_v * g_v
            past_b += error.sum() ** 2
            m.weights[used] -= RATE * g_w / np.sqrt(past_w[used])
            m.vectors[used] -= RATE * g_v / np.sqrt(past_v[used])
            m.bias -= RATE * error.sum() / np.sqrt(past_b)
    if share is not None and 0 < share < 1:
        own = y.mean()
        m.bias += np.log(share / (1 - share)) - np.log(own / (1 - own))
    return m


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: dict[int, int] | None = None) -> Machine:
    """A machine from a bounded sample of labelled documents; see TRAIN_ROWS.  Without both classes it is constant."""
    got = training_rows(docs, labels, label, rows or TRAIN_ROWS, LONGEST, SEED).orderBy("doc_id", "text").toArrow()
    share = labels.where(~held_out(F.col("doc_id"))).agg(F.avg(F.col(label).cast("double"))).first()[0]
    return train(got.column("text").to_pylist(), got.column("y").to_pylist(), share)


def _scored(batches: Iterator[pa.RecordBatch], told) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            scores = told.value.score(part.column(part.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(scores, pa.float64())], [*part.schema.names[:-1], "quality_score"])


def scored(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """``docs`` with ``quality_score`` from 0 to 1, of the whole text; null is scored as the empty text.

    All rows and columns pass; a column named quality_score is replaced.
    """
    told = docs.sparkSession.sparkContext.broadcast(machine)  # about a megabyte, whatever the corpus
    kept = [F.col(f"`{c}`") for c in docs.columns if c != "quality_score"]
    named = docs.select(*kept, F.col(f"`{text_col}`").cast("string").alias("__text"))
    schema = T.StructType([f for f in docs.schema if f.name != "quality_score"]).add("quality_score", "double")
    return named.mapInArrow(partial(_scored, told=told), schema)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``."""
    found = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"),
    )

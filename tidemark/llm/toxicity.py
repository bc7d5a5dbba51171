"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is a bag of character n-grams within its words, word ends included, hashed into buckets.  The buckets' embeddings
are averaged, and a linear softmax gives the classes.  A misspelling that training never saw still shares most n-grams
with the word it stands for.

A few insults in a long text would vanish in one average, so bags are taken over short runs of words and a document has the
score of its worst run.  Training learns the same: first from any runs, then, of each document, from the runs that score
worst so far, under the document's label.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.labelled import held_out, training_rows
from tidemark.llm.memory import give_back

#: Labelled documents from which training learns, at most, by class; none is longer than LONGEST characters.
TRAIN_ROWS = {1: 1500, 0: 3000}
LONGEST = 8_000
BUCKET_BITS = 18
DIM = 8
#: Half a run: runs are this many words and the as many that follow, at every such step.
STEP_WORDS = 6
SIZES = (3, 4, 5)
WARM, EPOCHS, RATE, SEED = 3, 8, 0.5, 3
#: A small sample is passed more often: so many documents are looked at in all, as long as passes don't exceed this many.
LOOKS, MOST_EPOCHS = 30_000, 60
THRESHOLD = 0.3
BLOCK_CHARS = 1 << 17
_WORD = re.compile(r"\S+")


@dataclass(frozen=True)
class Bags:
    """N-grams of a block of texts by half run: half run i has ``buckets[cuts[i]:cuts[i + 1]]`` and is of ``text_of[i]``."""

    buckets: np.ndarray
    cuts: np.ndarray
    text_of: np.ndarray


def _parts(text: str) -> Iterator[tuple[str, bool]]:
    """A text in parts of about BLOCK_CHARS, and whether another follows.

    A part ends with a whole half run, and the next begins with the same one, so every run lies whole in a part.
    """
    at = 0
    while len(text) - at > BLOCK_CHARS:
        halves, words = [], 0
        for word in _WORD.finditer(text, at):
            if words % STEP_WORDS == 0:
                if len(halves) > 1 and word.start() - at >= BLOCK_CHARS:
                    break
                halves.append(word.start())
            words += 1
        else:
            break
        yield text[at : word.start()], True
        at = halves[-1]
    yield text[at:], False


def _blocks(texts: list[str | None]) -> Iterator[tuple[list[int], list[str], bool]]:
    """Texts, or parts of long ones, in blocks of about BLOCK_CHARS: (numbers of the texts, parts, whether the last part goes on)."""
    numbers, parts, size = [], [], 0
    for number, text in enumerate(texts):
        for part, goes_on in _parts((text or "").lower()):
            numbers.append(number)
            parts.append(part)
            size += len(part) + 1
            if size >= BLOCK_CHARS:  # as after any part that goes on
                yield numbers, parts, goes_on
                numbers, parts, size = [], [], 0
    if parts:
        yield numbers, parts, False


_SPACES = np.zeros(0x3001, dtype=bool)
_SPACES[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True
_SPACES[0x2000:0x200B] = True


def bags(numbers: list[int], parts: list[str]) -> Bags:
    joined = " " + " ".join(parts) + "     "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    space = (points < len(_SPACES)) & _SPACES[np.minimum(points, len(_SPACES) - 1)]
    points = np.where(space, np.uint32(32), points)
    # A word begins at the white space before it.
    words = np.flatnonzero(space[:-1] & ~space[1:])
    begins = np.cumsum([0] + [len(p) + 1 for p in parts])  # the white space before each part
    first = np.searchsorted(words, begins[:-1])
    part_of = np.searchsorted(begins, words, side="right") - 1
    halves = np.flatnonzero((np.arange(len(words)) - first[np.minimum(part_of, len(first) - 1)]) % STEP_WORDS == 0)
    text_of = np.array(numbers, dtype=np.int64)[part_of[halves]]
    if not len(halves):
        return Bags(np.empty(0, dtype=np.int32), np.zeros(1, dtype=np.int64), text_of)
    half_at = np.zeros(len(points), dtype=np.int32)
    half_at[words[halves]] = 1
    half_at = np.cumsum(half_at) - 1
    n = len(points) - max(SIZES)
    inner = ~space
    able, rolling = np.ones(n, dtype=bool), points[:n] * np.uint32(2654435761)
    found, owner = [], []
    for k in range(1, max(SIZES)):
        rolling = (rolling ^ (rolling >> np.uint32(15))) * np.uint32(2246822519) + points[k : k + n] * np.uint32(3266489917)
        if k > 1:
            able = able & inner[k - 1 : k - 1 + n]
        if k + 1 in SIZES:
            at = np.flatnonzero(able)
            h = rolling[at] + np.uint32(k)
            h = (h ^ (h >> np.uint32(16))) * np.uint32(2146121005)
            found.append((h >> np.uint32(32 - BUCKET_BITS)).astype(np.int32))
            owner.append(half_at[at])
    buckets, half_of = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(half_of, kind="stable")
    cuts = np.searchsorted(half_of, np.arange(len(halves) + 1), sorter=order)
    return Bags(buckets[order], cuts, text_of)


@dataclass(frozen=True)
class Model:
    """What scoring needs: the softmax of two classes of an average is a number for each bucket and one more."""

    gain: np.ndarray
    bias: float

    def runs(self, b: Bags) -> np.ndarray:
        """Log-odds of the run that begins with each half run."""
        n = len(b.text_of)
        sums = np.concatenate(([0], np.cumsum(self.gain[b.buckets])))[b.cuts]
        total, count = np.diff(sums), np.diff(b.cuts).astype(float)
        goes_on = np.append(b.text_of[1:] == b.text_of[:-1], False) if n else np.empty(0, dtype=bool)
        total = total + np.where(goes_on, np.append(total[1:], 0), 0)
        count = count + np.where(goes_on, np.append(count[1:], 0), 0)
        return total / np.maximum(count, 1) + self.bias

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability of class 1 of each text's worst run; 0 without words."""
        worst = np.full(len(texts), -np.inf)
        for numbers, parts, goes_on in _blocks(texts):
            b = bags(numbers, parts)
            scored = len(b.text_of) - goes_on  # a last half run that goes on is scored with what follows it
            np.maximum.at(worst, b.text_of[:scored], self.runs(b)[:scored])
        return 1 / (1 + np.exp(-np.clip(worst, -700, 700))) * np.isfinite(worst)


def train(texts: list[str], labels: list[int]) -> Model:
    """Embeddings and softmax weights, by steps scaled with their past gradients (AdaGrad) on both at once."""
    draw = np.random.default_rng(SEED)
    size = 1 << BUCKET_BITS
    vectors = draw.normal(0, 0.1, (size, DIM)).astype(np.float32)
    weights = draw.normal(0, 0.3, (DIM, 2)).astype(np.float32)
    bias = np.array([2, -2], dtype=np.float32)  # what nothing is known of is taken for clean
    past = [np.full(x.shape, 1e-6, dtype=np.float32) for x in (vectors, weights, bias)]
    y = np.array(labels)
    if len(set(labels)) < 2:
        return Model(np.zeros(size), -20.0 if not y.any() else 20.0)
    blocks = [bags(numbers, parts) for numbers, parts, _ in _blocks(texts)]  # none goes on, as LONGEST is less than a block

    def model():
        return Model((vectors @ (weights[:, 1] - weights[:, 0])).astype(np.float64), float(bias[1] - bias[0]))

    more = max(1.0, min(MOST_EPOCHS / EPOCHS, LOOKS / (EPOCHS * len(texts))))
    warm = round(WARM * more)
    for epoch in range(warm + round(EPOCHS * more)):
        now = model()
        for i in draw.permutation(len(blocks)):
            b = blocks[i]
            n, buckets, cuts = len(b.text_of), b.buckets, b.cuts
            if not n:
                continue
            if epoch < warm:
                chosen = np.flatnonzero(draw.random(n) < 0.25)
            else:
                runs = now.runs(b)
                order = np.lexsort((-runs, b.text_of))
                place = np.arange(n) - np.searchsorted(b.text_of[order], b.text_of[order])
                # The worst run of each document, and of clean ones two more.
                worst = order[(place == 0) | ((place < 3) & (y[b.text_of[order]] == 0))]
                chosen = np.sort(worst)
            if not len(chosen):
                continue
            ends = np.where(np.append(b.text_of[1:] == b.text_of[:-1], False)[chosen], chosen + 2, chosen + 1)
            spans = [buckets[cuts[a] : cuts[e]] for a, e in zip(chosen, ends, strict=True)]
            lengths = np.array([len(s) for s in spans])
            chosen, spans, lengths = chosen[lengths > 0], [s for s in spans if len(s)], lengths[lengths > 0]
            if not len(spans):
                continue
            flat = np.concatenate(spans)
            bag_of = np.repeat(np.arange(len(spans)), lengths)
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            mean = np.add.reduceat(vectors[flat], starts) / lengths[:, None]
            logits = mean @ weights + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(p)), y[b.text_of[chosen]]] -= 1
            p /= len(p)
            to_mean = (p @ weights.T) / lengths[:, None]
            used, at = np.unique(flat, return_inverse=True)
            to_vectors = np.stack([np.bincount(at, to_mean[bag_of, d], minlength=len(used)) for d in range(DIM)], axis=1)
            for x, g, seen, where in (
                (vectors, to_vectors, past[0], used),
                (weights, mean.T @ p, past[1], slice(None)),
                (bias, p.sum(axis=0), past[2], slice(None)),
            ):
                seen[where] += (g * g).astype(np.float32)
                x[where] -= (RATE * g / np.sqrt(seen[where])).astype(np.float32) * (0.2 if x is not vectors else 1.0)
    return model()


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: dict[int, int] | None = None) -> Model:
    """A model from a bounded sample of labelled documents; see TRAIN_ROWS.  Without both classes it is constant.

    The sample goes to one task, which trains; the driver gets the model alone.
    """
    sample = training_rows(docs, labels, label, rows or TRAIN_ROWS, LONGEST, SEED)
    trained = sample.repartition(1).mapInArrow(_trained, "model binary").head()
    return pickle.loads(trained[0]) if trained else train([], [])


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted(r for b in batches for r in zip(*(b.column(n).to_pylist() for n in ("doc_id", "text", "y")), strict=True))
    if rows:
        model = pickle.dumps(train([r[1] for r in rows], [r[2] for r in rows]))
        rows.clear()
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])


def _scored(batches: Iterator[pa.RecordBatch], told) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts = part.column(part.num_columns - 1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array(told.value.score(texts), pa.float64())], [*part.schema.names[:-1], "toxicity"]
            )
    give_back()


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``toxicity`` from 0 to 1, of the whole text; 0 for null, empty and blank texts.

    All rows and columns pass; a column named toxicity is replaced.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)  # two megabytes, whatever the corpus
    kept = [F.col(f"`{c}`") for c in docs.columns if c != "toxicity"]
    named = docs.select(*kept, F.col(f"`{text_col}`").cast("string").alias("__text"))
    schema = T.StructType([f for f in docs.schema if f.name != "toxicity"]).add("toxicity", "double")
    return named.mapInArrow(partial(_scored, told=told), schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``."""
    found = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that score ``threshold`` or more; all columns pass."""
    kept = docs.columns
    aside = "toxicity_" + "_".join(c for c in kept if c.startswith("toxicity"))  # longer than any such name, so a new one
    found = scored(docs.withColumnRenamed("toxicity", aside), fit(docs, labels))
    found = found.where(F.col("toxicity") < threshold).drop("toxicity")
    return found.withColumnRenamed(aside, "toxicity").select(*[F.col(f"`{c}`") for c in kept])



"""Boosted trees for several classes with probabilities, from per-class gradient histograms.

Each round grows one tree a class on the gradients of the softmax loss.  Spark's own boosted trees know two classes, and one
against the rest gives no shares that sum to one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.staging import staged

#: Gradients are added up as whole numbers of this size, so a sum depends on no order, part or retry.
UNIT = float(1 << 20)
_CELLS = "class int, cell long, g long, h long"


@dataclass
class Forest:
    """Trees by round and class, as arrays over the places of a complete binary tree (children of i: 2i + 1, 2i + 2)."""

    classes: int
    depth: int
    split: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def places(self, split: np.ndarray, cut: np.ndarray, bins: np.ndarray, levels: int) -> np.ndarray:
        """Where each row arrives after ``levels`` splits; rows stay at a place that isn't split."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(levels):
            f = split[at]
            right = bins[rows, np.maximum(f, 0)] > cut[at]
            at = np.where(f >= 0, 2 * at + 1 + right, at)
        return at

    def raw(self, bins: np.ndarray, first: int = 0) -> np.ndarray:
        """Added values of the rounds from ``first`` on."""
        out = np.zeros((len(bins), self.classes))
        for split, cut, value in zip(self.split[first:], self.cut[first:], self.value[first:], strict=True):
            for k in range(self.classes):
                out[:, k] += value[k][self.places(split[k], cut[k], bins, self.depth)]
        return out


def shares(raw: np.ndarray) -> np.ndarray:
    e = np.exp(raw - raw.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def binned(columns: Sequence[np.ndarray], edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bin numbers: 0 for a missing value, else one more than the edges below it."""
    out = np.zeros((len(columns[0]) if columns else 0, len(columns)), np.uint8)
    for i, (x, e) in enumerate(zip(columns, edges, strict=True)):
        out[:, i] = np.where(np.isnan(x), 0, np.searchsorted(e, x, side="left") + 1)
    return out


def _numbers(column: pa.Array) -> np.ndarray:
    return np.asarray(column.cast(pa.float64()).to_numpy(zero_copy_only=False), float)


def _bins_of(column: pa.Array, features: int) -> np.ndarray:
    whole = b"".join(column.to_pylist())
    return np.frombuffer(whole, np.uint8).reshape(len(column), features)


def _histograms(batches: Iterator[pa.RecordBatch], forest: Forest, grown: tuple, level: int, known: int, features: int, width: int):
    """Sums of gradients and their slopes by (class, place on this level, feature, bin): one task's share."""
    first, places = (1 << level) - 1, 1 << level
    g = np.zeros((forest.classes, places * features * width), np.int64)
    h = np.zeros_like(g)
    for batch in batches:
        if not batch.num_rows:
            continue
        bins = _bins_of(batch.column("bins"), features)
        y, w = _numbers(batch.column("y")).astype(np.int64), _numbers(batch.column("w"))
        before = np.array(batch.column("raw").to_pylist(), float)
        p = shares(before + forest.raw(bins, known))
        for k in range(forest.classes):
            at = forest.places(grown[0][k], grown[1][k], bins, level) - first
            live = (at >= 0) & (at < places)
            gk = np.rint((p[:, k] - (y == k)) * w * UNIT).astype(np.int64)[live]
            hk = np.rint(p[:, k] * (1 - p[:, k]) * w * UNIT).astype(np.int64)[live]
            for f in range(features):
                cells = (at[live] * features + f) * width + bins[live, f]
                np.add.at(g[k], cells, gk)
                np.add.at(h[k], cells, hk)
    for k in range(forest.classes):
        used = np.flatnonzero((g[k] != 0) | (h[k] != 0))
        yield pa.RecordBatch.from_pydict(
            {"class": pa.array(np.full(len(used), k), pa.int32()), "cell": pa.array(used), "g": pa.array(g[k][used]), "h": pa.array(h[k][used])}
        )


def _with_raw(batches: Iterator[pa.RecordBatch], forest: Forest, known: int, features: int):
    for batch in batches:
        if batch.num_rows:
            bins = _bins_of(batch.column("bins"), features)
            raw = np.array(batch.column("raw").to_pylist(), float) + forest.raw(bins, known)
            yield pa.RecordBatch.from_arrays(
                [batch.column("bins"), batch.column("y"), batch.column("w"), pa.array(raw.tolist(), pa.list_(pa.float64()))], ["bins", "y", "w", "raw"]
            )


_ROWS = "bins binary, y double, w double, raw array<double>"


class SoftmaxBoosting(Estimator):
    """Fits ``rounds`` times one tree a class; missing values are a bin of their own, below all others.

    Features are cut at ``bins - 1`` quantiles, so that a level of all trees of a round is one pass over rows of one byte a
    feature.  Each task adds up its histograms in arrays of fixed size (classes x places x features x bins), Spark adds them
    by cell, and the driver sees those sums alone: no more of them for more rows.  Scores so far are written with
    the rows every ``refresh`` rounds; a lost executor costs the passes since.  An empty training frame or labels that
    aren't 0 to ``classes - 1`` raise a ValueError.
    """

    def __init__(
        self, features: Sequence[str], label: str, classes: int = 3, weight: str | None = None, rounds: int = 40, depth: int = 3,
        step: float = 0.1, bins: int = 32, l2: float = 1.0, least_slope: float = 5.0, refresh: int = 10,
    ):
        super().__init__()
        if not 2 <= bins <= 255 or depth < 1 or classes < 2:
            raise ValueError("2 to 255 bins, a depth of 1 or more and two or more classes")
        self.features, self.label, self.classes, self.weight = list(features), label, classes, weight
        self.rounds, self.depth, self.step, self.bins = rounds, depth, step, bins
        self.l2, self.least_slope, self.refresh = l2, least_slope, refresh

    def _fit(self, dataset: DataFrame) -> SoftmaxBoostingModel:
        typed = dataset.select(
            *[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(self.features)], F.col(self.label).cast("double").alias("y"),
            (F.col(self.weight).cast("double") if self.weight else F.lit(1.0)).alias("w"),
        )
        seen = typed.agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("a"), F.max("y").alias("b"), F.count_if(F.col("y").isNull() | (F.col("y") % 1 != 0)).alias("odd")).head()
        if not seen["n"] or seen["odd"] or seen["a"] < 0 or seen["b"] >= self.classes:
            raise ValueError(f"labels must be 0 to {self.classes - 1}, and there must be rows")
        quantiles = [i / self.bins for i in range(1, self.bins)]
        names = [f"f{i}" for i in range(len(self.features))]
        edges = [np.unique(np.array(e, float)) for e in typed.replace(float("nan"), None, names).approxQuantile(names, quantiles, 0.001)]
        n_features, width = len(names), self.bins + 1
        classes = self.classes

        def start(batches):
            for batch in batches:
                made = binned([_numbers(batch.column(i)) for i in range(n_features)], edges)
                raw = pa.array([[0.0] * classes] * len(made), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in made], pa.binary()), batch.column("y"), batch.column("w"), raw], ["bins", "y", "w", "raw"])

        rows = staged(typed.mapInArrow(start, _ROWS), "boosting-rows")
        forest, known = Forest(classes, self.depth), 0
        for number in range(self.rounds):
            if number and number % self.refresh == 0:
                past, had = Forest(classes, self.depth, list(forest.split), list(forest.cut), list(forest.value)), known
                rows = staged(rows.mapInArrow(lambda b, past=past, had=had: _with_raw(b, past, had, n_features), _ROWS), "boosting-rows")
                known = number
            self._grow(rows, forest, known, n_features, width)
        return SoftmaxBoostingModel(self.features, edges, forest)

    def _grow(self, rows: DataFrame, forest: Forest, known: int, features: int, width: int) -> None:
        """One round: all classes' trees level by level, each level one pass."""
        size = (2 << forest.depth) - 1
        split = [np.full(size, -1, np.int64) for _ in range(forest.classes)]
        cut = [np.zeros(size, np.int64) for _ in range(forest.classes)]
        value = [np.zeros(size) for _ in range(forest.classes)]
        for level in range(forest.depth):
            if level and not any((s[(1 << (level - 1)) - 1 : (1 << level) - 1] >= 0).any() for s in split):
                break
            grown = split, cut

            def pass_over(batches, grown=grown, level=level):
                return _histograms(batches, forest, grown, level, known, features, width)

            sums = rows.mapInArrow(pass_over, _CELLS).groupBy("class", "cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
            cells = np.zeros((forest.classes, 2, (1 << level) * features * width))
            found = sums.toArrow()  # bounded: classes x places x features x bins
            of, at = found["class"].to_numpy(), found["cell"].to_numpy()
            cells[of, 0, at], cells[of, 1, at] = found["g"].to_numpy() / UNIT, found["h"].to_numpy() / UNIT
            for k in range(forest.classes):
                for place in range(1 << level):
                    node = (1 << level) - 1 + place
                    if level and split[k][(node - 1) // 2] < 0:
                        continue
                    part = cells[k].reshape(2, 1 << level, features, width)[:, place]
                    self._split(node, part[0], part[1], split[k], cut[k], value[k])
        forest.split.append(np.array(split))
        forest.cut.append(np.array(cut))
        forest.value.append(np.array(value))

    def _split(self, node: int, g: np.ndarray, h: np.ndarray, split, cut, value) -> None:
        """The best cut of a node, ties to the first feature and bin, and the values of both sides (its own if it has none)."""
        whole_g, whole_h = g[0].sum(), h[0].sum()
        left_g, left_h = g.cumsum(axis=1)[:, :-1], h.cumsum(axis=1)[:, :-1]
        right_g, right_h = whole_g - left_g, whole_h - left_h
        gain = left_g**2 / (left_h + self.l2) + right_g**2 / (right_h + self.l2) - whole_g**2 / (whole_h + self.l2)
        gain = np.where((left_h >= self.least_slope) & (right_h >= self.least_slope), gain, 0.0)
        if node == 0:
            value[0] = -self.step * whole_g / (whole_h + self.l2)
        best = int(np.argmax(gain))
        if gain.flat[best] <= 1e-9:
            return
        f, b = divmod(best, gain.shape[1])
        split[node], cut[node] = f, b
        value[2 * node + 1] = -self.step * left_g[f, b] / (left_h[f, b] + self.l2)
        value[2 * node + 2] = -self.step * right_g[f, b] / (right_h[f, b] + self.l2)


class SoftmaxBoostingModel(Model):
    """Adds ``probability``, a vector whose shares sum to one, and ``prediction``, the likeliest class (ties: the smaller)."""

    def __init__(self, features: Sequence[str], edges: Sequence[np.ndarray], forest: Forest):
        super().__init__()
        self.features, self.edges, self.forest = list(features), edges, forest

    @property
    def numClasses(self) -> int:  # noqa: N802 - named as in Spark's own models
        return self.forest.classes

    def _transform(self, dataset: DataFrame) -> DataFrame:
        edges, forest = self.edges, self.forest

        @F.arrow_udf("array<double>")
        def probabilities(*columns: pa.Array) -> pa.Array:
            p = shares(forest.raw(binned([_numbers(c) for c in columns], edges)))
            return pa.array(p.tolist(), pa.list_(pa.float64()))

        scored = dataset.withColumn("__shares", probabilities(*[F.col(f).cast("double") for f in self.features]))
        best = F.array_position("__shares", F.array_max("__shares")) - 1
        return scored.withColumns({"probability": array_to_vector("__shares"), "prediction": best.cast("double")}).drop("__shares")

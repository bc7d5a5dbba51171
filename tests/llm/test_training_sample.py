"""What the classifiers learn from."""

from __future__ import annotations

import zlib

import numpy as np

from tidemark.llm import toxicity
from tidemark.llm.labelled import training_rows


def test_long_texts_leave_their_places_to_others(spark):
    rows = [(i, "word " * (400 if i % 2 else 4), i % 4 // 2) for i in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = training_rows(docs, labels, "toxic", {1: 20, 0: 20}, 1000, 3).collect()
    assert sorted(r.y for r in got) == [0] * 20 + [1] * 20 and all(len(r.text) <= 1000 for r in got)


def test_toxicity_learns_from_texts_of_8000_characters(spark):
    rows = [(i, "word " * 1500, i % 2) for i in range(40)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    taken = [r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    got = training_rows(docs, labels, "toxic", toxicity.TRAIN_ROWS, toxicity.LONGEST, toxicity.SEED).collect()
    assert sorted(r.doc_id for r in got) == taken
    assert toxicity.TRAIN_ROWS == {1: 1500, 0: 3000}


def test_repeats_and_conflicts_keep_the_bound(spark):
    """One id in ten thousand rows with many texts and labels counts once; one labelled both ways isn't learnt from."""
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2]
    hot, torn = ids[0], ids[1]
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(400)] + [(None, "x")], "doc_id long, text string")
    docs = docs.union(spark.range(10_000).selectExpr(f"{hot}L", "concat('other ', id % 50)"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(torn, 0), (torn, 1), (hot, None), (None, 1)], "doc_id long, toxic int")
    labels = labels.union(spark.range(10_000).selectExpr(f"{hot}L", f"CAST({hot % 2} AS INT)"))
    everything = training_rows(docs, labels, "toxic", {1: 1000, 0: 1000}, 100, 1).collect()
    assert sorted(r.doc_id for r in everything) == sorted(set(ids) - {torn})
    few = training_rows(docs, labels, "toxic", {1: 20, 0: 20}, 100, 1).collect()
    assert sorted(r.y for r in few) == [0] * 20 + [1] * 20
    assert training_rows(docs.limit(0), labels, "toxic", {1: 20, 0: 20}, 100, 1).count() == 0


def test_training_in_a_task_gives_the_same_model(spark):
    rows = [(i, f"{'rotten swine' if i % 2 else 'kind words'} number {i}", i % 2) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    known = sorted((r.doc_id, r.text, r.y) for r in training_rows(docs, labels, "toxic", toxicity.TRAIN_ROWS, toxicity.LONGEST, toxicity.SEED).collect())
    here = toxicity.train([r[1] for r in known], [r[2] for r in known])
    texts = [r[1] for r in rows]
    assert np.allclose(toxicity.fit(docs, labels).score(texts), here.score(texts))
    assert toxicity.fit(docs, labels.limit(0)).score(["swine"]) == toxicity.train([], []).score(["swine"])


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "good", 0.5, "a", "b")], "doc_id long, text string, toxicity double, __toxicity string, toxicity_ string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, "good", 0.5, "a", "b")]

"""Spelling variants against plain Python over all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
from llm.conftest import SCHEMA

from tidemark.llm import reduced_alphabet as ra


def plain_words(rows, noise) -> dict[str, int]:
    counts: Counter = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if noise and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_apart(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(words: dict[str, int]) -> dict[str, tuple]:
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        if found:
            best = min(found, key=lambda v: (-words[v], v))
            if words[best] >= 5 * words[w]:
                form[w] = best
    out = {}
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None)
    return out


def texts() -> list[tuple]:
    draw = random.Random(5)
    stems = ["running", "rüstung", "calling", "façade", "zzzzzz", "ÀÉÎõüÿ", "aaaaaaa", "banana", "cabana", "stopping"]
    rows = [(0, None, None, None, None), (1, "", None, None, 0), (None, "running " * 7, None, None, 1), (2, "x" * 300 + " ", None, None, 1)]
    for i in range(400):
        said = []
        for _ in range(60):
            w = draw.choice(stems)
            for _ in range(draw.choice([0, 0, 0, 0, 0, 1, 1, 2])):
                at = draw.randrange(len(w) + 1)
                w = draw.choice([w[:at] + w[at + 1 :], w[:at] + draw.choice("abngzé") + w[at:], w[:at] + draw.choice("abngzé") + w[at + 1 :]])
            said.append(draw.choice([w, w, w.upper(), w.capitalize()]))
        rows.append((1000 + i, draw.choice([" ", ", ", "1", "×", "ā"]).join(said), None, "s", 1))
    rows += [(500, "runing calling, caling " * 3, None, None, 1)] * 4
    rows += [(600 + i, f"{'q' * 5000}a {'q' * 5000}b {'q' * 5000}", None, None, 1) for i in range(6)]
    return rows


def test_against_all_pairs(spark):
    rows = texts()
    df = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"source": "word", "lang": "n"}).repartition(5)
    for noise in (None, 7):
        words = plain_words(rows, noise)
        assert len(words) > 60
        got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in ra.spelling_variants(df, noise).collect()}
        assert got == plain_variants(words)


def test_any_alphabet_gives_the_same(spark):
    words = plain_words(texts(), None)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = {(a, b) for a in words for b in words if one_apart(a, b)}
    for symbols in (2, 4, 9):
        assert {(r.word, r.near) for r in ra.near_words(df, symbols).collect()} == want


def test_chain_of_forms(spark):
    """Each word one letter longer and five times as frequent: all lead to the last."""
    words = [("abcdef" + "g" * i, 5 ** (i + 1)) for i in range(12)]
    got = {r.word: r.root for r in ra.variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert set(got.values()) == {words[-1][0]} and len(got) == 12


def test_neighbourhoods_are_full():
    import itertools

    for n, symbols in ((1, 2), (3, 3), (5, 2)):
        row = np.array([[i % symbols for i in range(n)]], dtype=np.uint8)
        text = tuple(row[0].tolist())
        near = {text[:i] + text[i + 1 :] for i in range(n)} | {text[:i] + (c,) + text[i + k :] for k in (0, 1) for i in range(n + 1 - k) for c in range(symbols)}
        numbers = set(ra.neighbourhoods(row, symbols)[0].tolist())
        said = {}
        for length in range(n + 2):
            for s in itertools.product(range(symbols), repeat=length):
                said[int(ra._numbers(np.array([s], dtype=np.uint8).reshape(1, length), symbols)[0])] = s
        assert {said[x] for x in numbers} == near


def test_long_texts_are_cut_between_runs(monkeypatch):
    text = " ".join(random.Random(2).choice(["running", "jumping", "a"]) for _ in range(500))
    whole = ra._runs(text)
    monkeypatch.setattr(ra, "_CHUNK", 11)
    assert ra._runs(text) == whole


def test_empty(spark, empty):
    assert ra.spelling_variants(empty, 199).collect() == []

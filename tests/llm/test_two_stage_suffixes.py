"""Repeated passages against plain Python over all strings."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from llm.conftest import SCHEMA, odd_rows, prose

from tidemark.llm import two_stage_suffixes as ts
from tidemark.plans.staging import staged


def plain_runs(texts: list[bytes], length: int = ts.LENGTH) -> list[list[tuple[int, int]]]:
    """Runs of each of ``texts``, in their order."""
    seen, out = set(), []
    for data in texts:
        covered = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if data[i : i + length] in seen:
                covered[i : i + length] = b"\1" * length
            seen.add(data[i : i + length])
        marks = np.diff(np.frombuffer(b"\0" + bytes(covered) + b"\0", dtype=np.int8))
        out.append(list(zip(np.flatnonzero(marks == 1).tolist(), np.flatnonzero(marks == -1).tolist())))
    return out


def check(spark, rows, parts=5):
    df = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"lang": "place", "source": "mark", "n_chars": "data"}).repartition(parts)
    got = sorted((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], r.kept) for r in ts.without_repeats(df).collect())
    rows = sorted(rows, key=lambda r: r[0])
    texts = [(r[1] or "").encode() for r in rows]
    want = []
    for (doc_id, *_), data, runs in zip(rows, texts, plain_runs(texts)):
        kept = b"".join(data[a:b] for a, b in zip([0] + [b for _, b in runs], [a for a, _ in runs] + [len(data)]))
        want.append((doc_id, len(data), runs, kept))
    assert got == want
    return sum(b - a for _, _, runs, _ in got for a, b in runs)


def passages() -> list[tuple]:
    draw = random.Random(4)
    shared = [prose(900 + i, 40) for i in range(6)] + ["é" * 130, "a" * 260, "ab" * 90, "\0" * 120, "x" * 99, "𝄞 " * 40]
    rows = [(0, None), (1, ""), (2, "a" * 100), (3, "a" * 101), (4, "b" * 99), (5, "b" * 99), (6, "a" * 1500)]
    for i in range(120):
        parts = [draw.choice(shared)[draw.randrange(30) :] if draw.random() < 0.4 else prose(draw.randrange(10**6), draw.randrange(2, 60)) for _ in range(4)]
        rows.append((10 + i, draw.choice([" ", "", "\n"]).join(parts)))
    rows += [(300 + i, rows[50][1]) for i in range(40)]
    for i in range(40):
        text = rows[60][1]
        at = draw.randrange(len(text))
        rows.append((400 + i, text[:at] + "!" + text[at + 1 :]))
    draw.shuffle(rows)
    return [(i, t, "x", "y", 1) for i, t in rows]


@pytest.mark.parametrize("together", [ts.TOGETHER, 2])
def test_against_all_strings(spark, monkeypatch, together):
    """Also with anchors whose contexts take many chunks."""
    monkeypatch.setattr(ts, "TOGETHER", together)
    monkeypatch.setattr(ts, "_SORT_BYTES", 2000)
    assert check(spark, passages()) > 50_000


def test_long_texts_in_pieces(spark):
    """Texts longer than a block, with passages across its edges, repeated inside and elsewhere."""
    draw = random.Random(8)
    long = "".join(chr(draw.randrange(97, 123)) for _ in range(2 * ts._BLOCK + 777))
    edge = long[ts._BLOCK - 150 : ts._BLOCK + 170]
    rows = [(1, long + edge), (2, "z" + edge[:250]), (3, edge[100:]), (4, "q" * (ts._BLOCK + 500)), (5, "r" * 50 + long[-400:])]
    check(spark, [(i, t, None, None, 1) for i, t in rows], parts=2)


def test_odd_rows(spark, odd):
    """Null and repeated ids: copies of a document have its result, and every later text loses what an earlier one has."""
    got = ts.without_repeats(odd).collect()
    assert len(got) == len(odd_rows())
    base = next(r[1] for r in odd_rows() if r[0] == 10).encode()
    by_id = {r.doc_id: r for r in got}
    assert not by_id[10].spans and by_id[11].kept == b"" and len(by_id[11].spans) == 1
    assert by_id[None].kept in (b"", ("no id but text " * 20).encode()[: by_id[None].n_bytes - sum(s.end - s.start for s in by_id[None].spans)])
    assert sum(r.kept == base for r in got) == 1
    twice = [(7, prose(1, 50))] * 3 + [(None, prose(2, 50))] * 2 + [(8, prose(3, 50)), (8, prose(4, 50))]
    kept = ts.without_repeats(spark.createDataFrame(twice, "doc_id long, text string")).collect()
    assert len(kept) == 7 and all(not r.spans for r in kept)


def test_empty(spark, empty):
    assert ts.without_repeats(empty).collect() == []


def test_order_is_a_suffix_array():
    draw = random.Random(3)
    for alphabet, n in ((2, 60), (3, 300), (250, 400)):
        for _ in range(40):
            text = np.array([draw.randrange(1, alphabet) if alphabet > 2 else draw.choice([1, 2]) for _ in range(draw.randrange(n))] + [0], dtype=np.uint8)
            data = text.tobytes()
            order = ts.two_stage_order(text, len(data))
            assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
            common = ts.common_prefixes(text, order, 5)
            for k in range(1, len(order)):
                a, b = data[order[k - 1] :], data[order[k] :]
                same = next((i for i in range(min(len(a), len(b), 5)) if a[i] != b[i]), min(len(a), len(b), 5))
                assert common[k] == same


def test_query_digests(spark, tmp_path):
    from tidemark.llm import queries

    rows = passages()[:60]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    want = {r.doc_id: r for r in ts.without_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    for r in queries.QUERIES["op13_two_stage_sorting"](spark, str(tmp_path)).collect():
        runs = [(s.start, s.end) for s in want[r.doc_id].spans]
        assert (r.n_removed, r.n_spans) == (sum(b - a for a, b in runs), len(runs))
        assert r.kept_sha256 == hashlib.sha256(want[r.doc_id].kept).hexdigest()


def test_texts_are_shuffled_once(spark):
    """Both readings of the texts by document take the same exchange."""
    rows = passages()
    docs = staged(spark.createDataFrame(rows, SCHEMA), "docs")
    out = ts.without_repeats(docs)
    out.collect()
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()

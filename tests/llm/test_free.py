"""Archives, scores, packing and fingerprints."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from llm.conftest import edited, odd_rows, prose
from pyspark.sql import functions as F

from tidemark.llm import factorisation, gamma_sampling, packing, toxicity, warc
from tidemark.llm.gamma_sampling import fingerprints, likeness

# Archives --------------------------------------------------------------------------------------------------------


def pages_rows() -> list[tuple]:
    nested = warc.member(warc.record(99, "http://n/", b"inner", None, False))
    html = [None, "", "same", "same", "<p>é😀</p>" * 500, "x" * 300_000, "\x1f\x8b\x08 no member", nested.decode("latin-1"), "same"]
    return [(i, f"http://h/{i}\r\nX: y", t) for i, t in enumerate(html)] + [(None, None, "same"), (None, None, "alone"), (2, "http://again/", "same")]


@pytest.mark.parametrize("range_bytes", [97, 5000, 1 << 20])
def test_round_trip_in_ranges(spark, tmp_path, range_bytes):
    pages = spark.createDataFrame(pages_rows(), "page_id long, url string, html string").withColumn("sha", F.lit("clash"))
    warc.write_warc(pages.repartition(3), str(tmp_path / "w"))
    got = warc.read_warc(spark, str(tmp_path / "w"), range_bytes).collect()
    assert len(got) == len(pages_rows())
    assert len({(r.file, r.place) for r in got}) == len(got)
    first = {}
    for i, _, t in pages_rows():
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    want = []
    for i, _, t in pages_rows():
        data = (t or "").encode()
        response = first.get(t or "", i) == i
        sha = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((i, len(data), sha, "response" if response else "revisit", None if response else first[t or ""], data if response else b""))
    have = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.block)) for r in got]
    assert Counter(have) == Counter(want)


def test_payloads_that_hold_members_don_t_mislead(tmp_path):
    """A stored (incompressible) payload with whole members in it, read from every place."""
    noise = np.random.default_rng(2).bytes(3000)
    inner = warc.member(warc.record(7, None, noise, None, False))
    data = b"".join(warc.member(warc.record(i, None, noise + inner * 2, None, False)) for i in range(3))
    (tmp_path / "f").write_bytes(data)
    starts = [p for p, _, _ in warc.records_in(str(tmp_path / "f"), len(data), 0, len(data))]
    assert len(starts) == 3
    for step in (501, 2048):
        found = [p for a in range(0, len(data), step) for p, _, _ in warc.records_in(str(tmp_path / "f"), len(data), a, min(a + step, len(data)))]
        assert found == starts


@pytest.mark.parametrize("range_bytes", [1 << 10, 1 << 25])
def test_long_urls_are_read_back(spark, tmp_path, range_bytes):
    noise = base64.b64encode(b"".join(hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(4_688))).decode()[:200_000]
    rows = [(1, "http://a/" + "x" * 200_000, "same"), (2, "http://b/" + noise, "same"), (3, "http://c/", "same"), (4, "http://d/" + noise, "other")]
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    got = {r.page_id: r for r in warc.read_warc(spark, str(tmp_path / "w"), range_bytes).collect()}
    assert {i: r.url for i, r in got.items()} == {i: url for i, url, _ in rows}
    assert [(got[i].record_type, got[i].refers_to) for i in (1, 2, 3, 4)] == [("response", None), ("revisit", 1), ("revisit", 1), ("response", None)]


def test_large_records_end_with_an_empty_member():
    big = warc.member(bytes(range(256)) * (1 << 17))
    assert big[-1] == 0 and big.endswith(bytes(8))
    assert zlib.decompressobj(31).decompress(big) == bytes(range(256)) * (1 << 17)


def test_no_pages(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert warc.read_warc(spark, str(tmp_path / "w")).count() == 0


# Packing ---------------------------------------------------------------------------------------------------------


def test_pieces_hold_the_tokenizers_ids(odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    texts = odd.unionByName(
        odd.sparkSession.createDataFrame(
            [(900, "a  b \n c  d\t e  ", "", "", 0), (901, "  <|endoftext|> it's  'll 12 3\n\n x ", "", "", 0), (902, " ", "", "", 0)], odd.schema
        )
    )
    pieces = packing.token_pieces(texts, capacity=64, keep_ids=True)
    rows = pieces.collect()
    want = Counter()
    for r in texts.collect():
        want[r.doc_id, tuple([*plain.encode(r.text or "", add_special_tokens=False).ids, 0])] += 1
    have = Counter()
    for key in {r.doc_id for r in rows}:
        own = sorted((r for r in rows if r.doc_id == key), key=lambda r: (r.piece, r.start))
        if sum(r.piece == 0 for r in own) == 1:
            assert [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own])[:-1])
            assert all(r.length == 64 for r in own[1:])
            have[key, tuple(np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist())] += 1
        assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in own)
    once = {k: v for k, v in want.items() if sum(1 for w in want.elements() if w[0] == k[0]) == 1}
    assert dict(have) == once


def test_parts_keep_the_tokenizers_ids():
    """Strings of odd white space, signs, scripts and the special token, taken apart and put together, against an untouched tokenizer."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.TOKENIZER)
    plain, own = Tokenizer.from_file(path), packing.PartTokenizer(path)
    draw = random.Random(6)
    bits = [" ", " ", " ", "\n", "\t", "\r", "\u00a0", "\u2003", "\u3000", "\u0085", "\u1680", "\x1c", "a", "word", "Été", "straße", "12", "3.5", "'s", "'ll",
            ".", ",", "...", "!?", "—", "«", "»", "×", "÷", "日本", "𝄞", "<|endoftext|>", "<|end", "|>", "_", "\0", "é", "É.", "ñ,", "²", "½;"]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randrange(14))) for _ in range(30_000)]
    for at in range(0, len(texts), 1000):
        some = [t.encode() for t in texts[at : at + 1000]]
        flat, ends = own.flat(np.frombuffer(b"".join(some), dtype=np.uint8), np.cumsum([0] + [len(t) for t in some]))
        for text, ids in zip(texts[at : at + 1000], np.split(flat, ends[:-1]), strict=True):
            assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
    assert plain.encode("end here <|endoftext|> next", add_special_tokens=False).ids == [437, 994, 220, 50256, 1306]


def test_forgetting_parts_changes_nothing(monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path(packing.TOKENIZER)
    data = np.frombuffer(" ".join(f"word{i} and" for i in range(500)).encode(), dtype=np.uint8)
    whole = packing.PartTokenizer(path).flat(data, np.array([0, 700, len(data)]))
    monkeypatch.setattr(packing, "REMEMBERED", 10)
    again = packing.PartTokenizer(path)
    for _ in range(2):
        for a, b in zip(whole, again.flat(data, np.array([0, 700, len(data)])), strict=True):
            assert a.tolist() == b.tolist()


def test_sequences_are_gapless(odd):
    pieces = packing.token_pieces(odd.withColumn("rank", F.lit(1)), capacity=100, keep_ids=True)
    rows = packing.packed(pieces, capacity=100).collect()
    assert len(rows) == pieces.count()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 100
    joined = packing.sequences(odd.sparkSession.createDataFrame(rows)).collect()
    assert {s.sequence_id: len(s.ids) // 4 for s in joined} == {k: sum(n for _, n in v) for k, v in by.items()}


def plain_best_two_fit(lengths: list[int], capacity: int) -> int:
    left, bins = Counter(lengths), 0
    while left:
        gap, used = capacity, Counter()
        while fits := [x for x in left if x <= gap and left[x] > used[x]]:
            used[max(fits)] += 1
            gap -= max(fits)
        free = left - used
        if gap:
            least = min(used)
            pairs = [(a + b, a, b) for a in free for b in free if a >= b and a + b <= gap + least and (a != b or free[a] > 1)]
            if pairs and max(pairs)[0] > least:
                _, a, b = max(pairs)
                used[least] -= 1
                used += Counter([a, b])
        left -= used
        bins += 1
    return bins


@pytest.mark.parametrize("seed", range(4))
def test_counted_packing_equals_bin_by_bin(seed):
    draw = np.random.default_rng(seed)
    lengths = np.minimum(draw.geometric(0.05, 400), 60).tolist() + [60] * 50
    plan = packing.best_two_fit(dict(Counter(lengths)), 60)
    assert plan.bins == plain_best_two_fit(lengths, 60)
    assert plan.bins >= -(-sum(lengths) // 60)


def test_packing_nothing(empty):
    assert packing.packed_documents(empty).count() == 0


# Fingerprints ----------------------------------------------------------------------------------------------------


def generalised(a: str, b: str) -> float:
    x, y = Counter(a.split()), Counter(b.split())
    return sum((x & y).values()) / sum((x | y).values())


def test_likeness_is_generalised_jaccard(spark):
    texts = [prose(i, 200) for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(fingerprints(docs, samples=64).collect())
    errors = []
    for i, r in enumerate(got):
        half = len(texts[i]) // 2
        other = texts[i][: len(texts[i]) - half] + texts[(i + 1) % 30][:half]
        assert r.n_chars == len(texts[i]) and r.edited_sha256 == hashlib.sha256(other.encode()).hexdigest()
        errors.append(r.near_edited - generalised(texts[i], other))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.1


def test_fingerprints_of_odd_rows(odd, empty):
    got = fingerprints(odd.withColumn("row", F.lit(1)).withColumn("what", F.lit("x"))).collect()
    assert len(got) == len(odd_rows())
    texts = {}
    for r in got:
        if r.doc_id is not None and 10 <= r.doc_id < 40:
            texts[r.doc_id] = r.fingerprint
    assert len(set(texts.values())) == 1
    copies = [r.near_next for r in got if r.doc_id is not None and 10 <= r.doc_id < 39]
    assert copies == [1.0] * 29
    assert {r.near_next for r in got if r.doc_id is None} == {None}
    assert fingerprints(empty).count() == 0


def test_fingerprints_where_most_rows_have_no_id(spark):
    """They don't share a key: each is edited by itself, and equal texts have equal fingerprints."""
    rows = [(i if i % 10 == 0 else None, prose(i % 7, 60)) for i in range(200)] + [(None, None), (None, ""), (-(2**63), "least id")]
    got = fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), samples=8).collect()
    assert len(got) == len(rows)
    nameless = [r for r in got if r.doc_id is None]
    halves = {(len(t or ""), hashlib.sha256((t or "")[: len(t or "") - len(t or "") // 2].encode()).hexdigest()) for i, t in rows if i is None}
    assert {(r.n_chars, r.edited_sha256) for r in nameless} == halves and len(nameless) == 182
    assert len({r.fingerprint for r in got}) == 9
    assert [r.near_next is not None for r in got if r.doc_id == -(2**63)] == [True]


@pytest.mark.parametrize("names", [("doc_id", "text"), ("id", "body"), ("renamed", "body")])
def test_texts_are_shuffled_once_for_both_reads(spark, tmp_path, monkeypatch, names):
    """The beginnings for the documents before are taken from the shuffle that the documents themselves are read from."""
    rows = [(i if i % 9 else None, prose(i, 40)) for i in range(60)] + [(5, "again")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d")).toDF(*names)
    if names[0] == "renamed":  # neither column can be null
        docs = docs.select(F.coalesce("renamed", F.lit(99)).alias("renamed"), F.coalesce("body", F.lit("")).alias("body"))
    plans, write = [], gamma_sampling.staged

    def watched(df, name):
        if name == "gamma-signed":
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0])
        return write(df, name)

    monkeypatch.setattr(gamma_sampling, "staged", watched)
    assert fingerprints(docs, 4, *names).count() == len(rows)
    assert [plan.count("ReusedExchange") for plan in plans] == [1]


def test_likeness_counts_equal_samples(spark):
    row = spark.createDataFrame([("00010002", "00010003")], "a string, b string").select(likeness(F.col("a"), F.col("b"), 2)).first()
    assert row[0] == 0.5


# Scores ----------------------------------------------------------------------------------------------------------


def labelled(spark, make):
    """Documents of two kinds, with labels, and their truth."""
    rows = [(i, make(i, i % 4 == 0), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 1 - r[2], r[2]) for r in rows] + [(None, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels, {r[0]: r[2] for r in rows}


def test_toxicity_on_held_out_documents(spark, odd, empty):
    insults = ["gronkle", "blathead", "snorvik"]

    def make(i, bad):
        words = prose(1000 + i, 120).split(" ")
        if bad:
            for k in range(4):
                words[(i * 7 + k * 29) % len(words)] = insults[(i + k) % 3]
        return " ".join(words)

    docs, labels, truth = labelled(spark, make)
    got = toxicity.toxicity(docs, labels).collect()
    out = [r for r in got if r.held_out]
    assert {r.doc_id for r in out} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    right = [r.predicted == truth[r.doc_id] for r in out]
    assert np.mean(right) > 0.95
    model = toxicity.fit(docs, labels)
    clean, misspelt = model.score([prose(1, 100), prose(1, 50) + " grronkle " + prose(2, 50) + " blatheadd snorrvik"])
    assert clean < toxicity.THRESHOLD < misspelt
    assert model.score([None, "", " \n"]).tolist() == [0, 0, 0]
    marked = odd.withColumn("toxicity", F.lit("clash"))
    kept = toxicity.without_toxic(marked, labels)
    assert kept.columns == marked.columns
    assert toxicity.without_toxic(empty, labels).count() == 0


def plain_bucket(gram: str) -> int:
    first, *others = map(ord, gram)
    h = first * 2654435761 % 2**32
    for point in others:
        h = ((h ^ (h >> 15)) * 2246822519 + point * 3266489917) % 2**32
    h = (h + len(others)) % 2**32
    return (h ^ (h >> 16)) * 2146121005 % 2**32 >> (32 - toxicity.BUCKET_BITS)


def plain_score(model, text: str | None) -> float:
    """The worst run's probability, run by run and n-gram by n-gram."""
    words = (text or "").lower().split()
    if not words:
        return 0.0
    padded = [f" {w} " for w in words]
    gains = [[model.gain[plain_bucket(w[i : i + n])] for n in toxicity.SIZES for i in range(len(w) - n + 1)] for w in padded]
    step = toxicity.STEP_WORDS
    runs = [sum(gains[i : i + 2 * step], []) for i in range(0, len(words), step)]
    odds = max(sum(r) / max(len(r), 1) for r in runs) + model.bias
    return 1 / (1 + math.exp(-odds))


@pytest.mark.parametrize("block", [40, 700, toxicity.BLOCK_CHARS])
def test_toxicity_scores_equal_plain_runs(monkeypatch, block):
    monkeypatch.setattr(toxicity, "BLOCK_CHARS", block)
    model = toxicity.Model(np.random.default_rng(1).normal(0, 9, 1 << toxicity.BUCKET_BITS), -1.0)
    texts = [r[1] for r in odd_rows()] + [prose(i, n) for i, n in enumerate([1, 5, 6, 7, 11, 12, 13, 40, 200])]
    texts += ["\u2003" + "\u00a0é😀 I\u0307".join("abcdefgh") + "\n\n", " a  b\tc " * 50, "x" * 3000 + " y " + "z" * 900]
    assert model.score(texts) == pytest.approx([plain_score(model, t) for t in texts], abs=1e-9)


def test_runs_of_very_long_texts_are_scored_across_cuts():
    """One bad word in a run that begins before the cut and ends behind it."""
    model = toxicity.Model(np.zeros(1 << toxicity.BUCKET_BITS), -1.0)
    for gram in ("gro", "onk", "nkl", "kle"):
        model.gain[plain_bucket(gram)] = 40
    words = prose(5, 30_000).split(" ")
    for at in range(21_000, 27_000, 500):
        words[at] = "gronkle"
    text = " ".join(words)
    assert len(text) > toxicity.BLOCK_CHARS
    assert model.score([text, "home", text[:100]]) == pytest.approx([plain_score(model, t) for t in (text, "home", text[:100])], abs=1e-9)


def test_quality_on_held_out_documents(spark, odd, empty):
    def make(i, bad):
        text = prose(3000 + i, 90)
        return " ".join(w + "#$" for w in text.split(" ")) if bad else text

    docs, labels, truth = labelled(spark, make)
    got = factorisation.quality(docs, labels).collect()
    out = [r for r in got if r.held_out]
    assert np.mean([r.predicted == 1 - truth[r.doc_id] for r in out]) > 0.95
    assert all(0 <= r.score <= 1 for r in factorisation.quality(odd, labels).collect())
    assert factorisation.quality(empty, labels).count() == 0
    clash = factorisation.scored(odd.withColumn("quality_score", F.lit("x")), factorisation.fit(docs, labels))
    assert clash.columns[-1] == "quality_score" and clash.count() == odd.count()


def test_interactions_equal_the_sum_over_pairs():
    machine = factorisation.train([prose(i, 60) + " %%%" * (i % 2) for i in range(20)], [i % 2 for i in range(20)])
    (at, x), *_ = machine.rows([edited(prose(3, 30), 1, 0.1)])
    pairs = sum(
        (machine.vectors[at[i]] @ machine.vectors[at[j]]) * x[i] * x[j] for i in range(len(at)) for j in range(i)
    )
    assert machine.log_odds(at, x) == pytest.approx(machine.bias + machine.weights[at] @ x + pairs)


def test_one_class_gives_a_constant(spark):
    docs, labels, _ = labelled(spark, lambda i, bad: prose(i, 20))
    only = labels.withColumn("toxic", F.lit(0)).withColumn("quality", F.lit(1))
    assert {r.predicted for r in toxicity.toxicity(docs, only).collect()} == {0}
    assert {r.predicted for r in factorisation.quality(docs, only).collect()} == {1}

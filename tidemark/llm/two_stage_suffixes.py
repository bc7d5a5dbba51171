"""Repeated passages: bytes covered by a string of LENGTH bytes that also starts earlier in the corpus.

Equal strings are brought together by anchors.  Of the grams inside a string the one with the least hash is its anchor, so
equal strings have the same anchor at the same place, and an anchor with the bytes around it (its context) holds
all strings that it stands for.  An anchor that occurs once, or always in one and the same context, needs no bytes: all
contexts but the earliest are repeats as they are.  That leaves the anchors with several contexts, a few percent of them.

Their contexts are laid behind one another in blocks and sorted in two stages: only suffixes smaller than their
successors are sorted directly, by their first LENGTH bytes, and the rest are induced by scans over the buckets of first
bytes.  Neighbours with a common prefix of LENGTH are one class, and all its members but the earliest are repeats.  An
anchor with very many contexts is dealt out over several blocks; the classes' earliest members, by hash of their bytes, then
meet once more.

Contexts are told apart by 64-bit BLAKE2 hashes among those of one anchor, whose own hash has 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.wordhash import mix
from tidemark.plans.staging import staged

LENGTH = 100
GRAM = 40
_SIDE = LENGTH - GRAM
#: Contexts of one anchor that are sorted together.
TOGETHER = 4096
_BLOCK = 1 << 18
_SORT_BYTES = 1 << 20
U = np.uint64
_NONE = U(2**64 - 1)
_BASE = 0x9E3779B97F4A7C15
_VALUES = mix(np.arange(1, 257, dtype=U) * U(_BASE))

# A place is one long: sign (set for rows without an id), 24 bits of the text's hash, 31 bits of offset, 8 bits of length.
_MARK = ~((1 << 39) - 1)
_OFFSET = (1 << 31) - 1


def _place(mark, start, length):
    return mark | (start << 8) | length


def marked(docs: DataFrame) -> DataFrame:
    """(doc, mark, data): what tells a document apart and its bytes.

    ``doc`` is the id, for rows without one a hash of the text; ``mark`` has bits of the text's hash, so that rows of
    one id with different texts are different documents, and its sign says that there is no id.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    bits = F.shiftleft(F.xxhash64(F.lit(13), text).bitwiseAND(F.lit((1 << 24) - 1).cast("long")), 39)
    sign = F.when(doc_id.isNull(), F.lit(-(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
    return docs.select(
        F.coalesce(doc_id, F.xxhash64(text)).alias("doc"), bits.bitwiseOR(sign).alias("mark"), text.cast("binary").alias("data")
    )


def _order() -> list[Column]:
    """Earlier first: rows without an id, then by id, text and offset."""
    return [F.col("place") >= 0, F.col("doc"), F.col("place")]


# Anchors ---------------------------------------------------------------------------------------------------------

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, 2 * _BLOCK), base, dtype=U)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=U)
    return _powers[base][:n]


def _windowed(x: np.ndarray, width: int, forward: bool) -> np.ndarray:
    """The least of each number and the next ones (forward), or the greatest of each and the ones before."""
    out, done = x.copy(), 1
    while done < width:
        step = min(done, width - done)
        if forward:
            np.minimum(out[:-step], out[step:], out=out[:-step])
        else:
            np.maximum(out[step:], out[:-step], out=out[step:])
        done += step
    return out


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the anchors in pieces of text that lie behind one another; ``ends`` has each byte's piece's end."""
    n = len(data) - GRAM + 1
    sums = np.zeros(len(data) + 1, dtype=U)
    np.cumsum(_VALUES[data] * _power(_BASE, len(data)), dtype=U, out=sums[1:])
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * _power(pow(_BASE, -1, 1 << 64), n)) >> U(1)
    at = np.arange(n)
    grams[at + GRAM > ends[:n]] = _NONE
    least = _windowed(grams, _SIDE + 1, True)
    least[at + LENGTH > ends[:n]] = 0
    chosen = np.flatnonzero((_windowed(least, _SIDE + 1, False) == grams) & (grams != _NONE))
    return chosen, grams[chosen]


def _pieces(docs: Iterator[tuple[int, int, bytes]]) -> Iterator[list[tuple]]:
    """Blocks of (doc, mark, bytes, offset, first, last): long texts are cut, and a piece owns anchors from first to last."""
    block, size = [], 0
    for doc, mark, data in docs:
        if len(data) < LENGTH:
            continue
        for first in range(0, len(data), _BLOCK):
            low, last = max(0, first - _SIDE), min(first + _BLOCK, len(data))
            piece = data[low : last + LENGTH]
            if size + len(piece) > 2 * _BLOCK:
                yield block
                block, size = [], 0
            block.append((doc, mark, piece, low, first, last))
            size += len(piece)
    if block:
        yield block


def _block_rows(block: list[tuple]) -> tuple[np.ndarray, ...]:
    """(anchor, context, doc, place) of a block's anchors."""
    data = b"".join(p[2] for p in block)
    lengths = np.array([len(p[2]) for p in block])
    upto = np.cumsum(lengths)
    piece = np.repeat(np.arange(len(block)), lengths)
    at, anchor = anchors(np.frombuffer(data, dtype=np.uint8), upto[piece])
    doc, mark = (np.array([p[i] for p in block], dtype=np.int64) for i in (0, 1))
    low, first, last = (np.array([p[i] for p in block], dtype=np.int64) for i in (3, 4, 5))
    of = piece[at]
    begin = (upto - lengths)[of]
    inside = at - begin + low[of]
    own = (inside >= first[of]) & (inside < last[of])
    at, anchor, of, begin = at[own], anchor[own], of[own], begin[own]
    start, end = np.maximum(begin, at - _SIDE), np.minimum(upto[of], at + LENGTH)
    context = b"".join(blake2b(data[a:b], digest_size=8).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True))
    place = _place(mark[of], start - begin + low[of], end - start)
    return anchor.astype(np.int64), np.frombuffer(context, dtype=np.int64), doc[of], place


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors with contexts; of equal contexts met together only the earliest goes on, the others are repeats at once."""
    names = ["anchor", "context", "doc", "place"]
    for batch in batches:
        docs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), (d.as_py() for d in batch.column(2)), strict=True)
        found = [_block_rows(b) for b in _pieces(docs)]
        if not found:
            continue
        anchor, context, doc, place = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((place, doc, place >= 0, context, anchor))
        anchor, context, doc, place = (c[order] for c in (anchor, context, doc, place))
        leads = np.ones(len(anchor), dtype=bool)
        leads[1:] = (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1])
        lead = np.maximum.accumulate(np.where(leads, np.arange(len(leads)), 0))
        again = (doc == doc[lead]) & (place == place[lead]) & ~leads
        keep = ~again
        # A repeat needs no company, so it gets an anchor of its own and isn't dealt to its group.
        anchor = np.where(leads, anchor, mix((doc ^ place).view(U)).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor[keep]), pa.array(context[keep], mask=~leads[keep]), pa.array(doc[keep]), pa.array(place[keep])], names
        )


def _anchor_table(docs: DataFrame) -> DataFrame:
    """(anchor, doc, place, chunk, shared): repeats (chunk null), and the contexts of anchors that have several.

    ``shared`` says that an anchor's contexts take more than one chunk.
    """
    rows = docs.mapInArrow(_anchor_rows, "anchor long, context long, doc long, place long")
    rows = rows.withColumn("sure", F.col("context").isNull())
    alike = W.partitionBy("anchor", "sure", "context").orderBy(*_order())
    nth = W.partitionBy("anchor", "sure").orderBy("context")
    ranked = rows.withColumn("earliest", F.rank().over(alike) == 1).withColumn("nth", F.dense_rank().over(nth))
    ranked = ranked.withColumn("contexts", F.max("nth").over(W.partitionBy("anchor", "sure")))
    repeat = F.col("sure") | ~F.col("earliest")
    chunk = F.when(~repeat, ((F.col("nth") - 1) / TOGETHER).cast("int"))
    kept = ranked.where(repeat | (F.col("contexts") > 1))
    return kept.select(
        F.when(~repeat, F.col("anchor")).alias("anchor"), "doc", "place", chunk.alias("chunk"), (F.col("contexts") > TOGETHER).alias("shared")
    )


# Sorting suffixes --------------------------------------------------------------------------------------------------


def two_stage_order(text: np.ndarray, width: int = LENGTH) -> np.ndarray:
    """All suffixes of bytes that end with their least byte, in the order of their first ``width`` bytes.

    Suffixes smaller than their successors are sorted directly.  Every other suffix follows its successor: going through the
    buckets of first bytes from the least on, the one before each suffix met is put at the end of its own bucket.
    """
    n = len(text)
    if n < 2:
        return np.arange(n)
    differs = np.append(text[:-1] != text[1:], True)
    turn = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]
    smaller = np.append(text[:-1] < text[1:], True)[turn]
    direct = np.flatnonzero(smaller)
    padded = np.concatenate([text, np.zeros(width, dtype=np.uint8)])
    views = np.lib.stride_tricks.sliding_window_view(padded, width)
    keys = np.ascontiguousarray(views[direct]).view(f"S{width}").ravel()
    direct = direct[np.argsort(keys, kind="stable")]
    cuts = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    order = []
    for byte in range(256):
        behind = []
        met = np.concatenate(waiting[byte]) if waiting[byte] else direct[:0]
        while len(met):
            order.append(met)
            before = met[met > 0] - 1
            before = before[~smaller[before]]
            behind.append(before[text[before] != byte])
            met = before[text[before] == byte]
        met = direct[cuts[byte] : cuts[byte + 1]]
        if len(met):
            order.append(met)
            before = met[met > 0] - 1
            behind.append(before[~smaller[before]])
        if behind:
            before = np.concatenate(behind)
            first = text[before]
            by = np.argsort(first, kind="stable")
            bounds = np.flatnonzero(np.diff(first[by])) + 1
            for some in np.split(before[by], bounds):
                if len(some):
                    waiting[text[some[0]]].append(some)
    return np.concatenate(order)


def common_prefixes(text: np.ndarray, order: np.ndarray, width: int = LENGTH) -> np.ndarray:
    """How many leading bytes, ``width`` at most, each suffix of ``order`` shares with the one before it; 0 for the first."""
    padded = np.concatenate([text, np.zeros(width, dtype=np.uint8)])
    views = np.lib.stride_tricks.sliding_window_view(padded, width)
    out = np.zeros(len(order), dtype=np.int64)
    for a in range(1, len(order), 1 << 15):
        b = min(a + (1 << 15), len(order))
        differs = views[order[a:b]] != views[order[a - 1 : b - 1]]
        out[a:b] = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
    return out


def _sorted_block(rows: list[tuple]) -> tuple[list, list, list]:
    """(hash, doc, place) of a block's repeats, whose hash is null, and of the classes' earliest members if it is shared."""
    lengths = np.array([len(r[3]) for r in rows])
    text = np.frombuffer(b"\0".join(r[3] for r in rows) + b"\0", dtype=np.uint8).copy()
    ends = np.cumsum(lengths + 1) - 1
    # UTF-8 has no byte over 0xF4, so bytes can make room for the one that ends a context.
    text += 1
    text[ends] = 0
    context = np.repeat(np.arange(len(rows)), lengths + 1)
    doc, place = (np.array([r[i] for r in rows], dtype=np.int64) for i in (1, 2))
    mark, start = place & _MARK, (place >> 8) & _OFFSET
    named = np.lexsort((mark, doc, mark >= 0))
    fresh = np.ones(len(rows), dtype=np.int64)
    fresh[1:] = (doc[named][1:] != doc[named][:-1]) | (mark[named][1:] != mark[named][:-1])
    rank = np.empty(len(rows), dtype=np.int64)
    rank[named] = np.cumsum(fresh)
    begin = ends - lengths
    at = two_stage_order(text)
    at = at[at + LENGTH <= ends[context[at]]]
    of = context[at]
    inside = start[of] + at - begin[of]
    earlier = rank[of] << 32 | inside
    heads = np.flatnonzero(common_prefixes(text, at) < LENGTH)
    least = np.repeat(np.minimum.reduceat(earlier, heads), np.diff(np.append(heads, len(at))))
    repeats = np.sort(at[earlier > least])
    out_hash, out_doc, out_place = [], [], []
    if len(repeats):
        apart = np.diff(repeats) > LENGTH
        apart |= context[repeats[1:]] != context[repeats[:-1]]
        first = repeats[np.append(True, apart)]
        last = repeats[np.append(apart, True)]
        c = context[first]
        spans = _place(mark[c], start[c] + first - begin[c], last + LENGTH - first)
        out_hash, out_doc, out_place = [None] * len(c), doc[c].tolist(), spans.tolist()
    if any(r[4] for r in rows):
        shared = np.array([r[4] for r in rows])
        first = at[(earlier == least) & shared[of]]
        c, raw = context[first], text.tobytes()
        out_hash += [blake2b(raw[a : a + LENGTH], digest_size=16).digest() for a in first.tolist()]
        out_doc += doc[c].tolist()
        out_place += _place(mark[c], start[c] + first - begin[c], LENGTH).tolist()
    return out_hash, out_doc, out_place


def _sorted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats among contexts, which come sorted by anchor and chunk; a block holds whole chunks of about _SORT_BYTES."""
    types = [pa.binary(), pa.int64(), pa.int64()]
    rows, size, last = [], 0, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(_sorted_block(rows), types, strict=True)], ["hash", "doc", "place"])

    for batch in batches:
        for anchor, chunk, doc, place, data, shared in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            group = (anchor, chunk)
            if group != last and size > _SORT_BYTES:
                yield out()
                rows, size = [], 0
            elif group == last and rows and rows[-1][1:3] == (doc, place):
                continue
            rows.append((group, doc, place, data, shared))
            size, last = size + len(data), group
    if rows:
        yield out()


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc, place) of byte ranges that are repeats, in documents as in ``marked``; ranges may overlap or be given twice."""
    table = staged(_anchor_table(docs), "suffix-anchors")
    sure = table.where("chunk IS NULL").select("doc", "place")
    item = F.struct("place", "anchor", "chunk", "shared")
    wanted = table.where("chunk IS NOT NULL").withColumn("mark", F.col("place").bitwiseAND(F.lit(_MARK).cast("long")))
    wanted = wanted.groupBy("doc", "mark").agg(F.collect_set(item).alias("items"))
    texts = docs.repartition("doc", "mark").join(wanted, ["doc", "mark"])
    at = texts.select("doc", "data", F.explode("items").alias("x")).select("doc", "data", "x.*")
    start = F.shiftright("place", 8).bitwiseAND(F.lit(_OFFSET).cast("long")).cast("int")
    length = F.col("place").bitwiseAND(F.lit(255).cast("long")).cast("int")
    contexts = at.select("anchor", "chunk", "doc", "place", F.substring("data", start + 1, length).alias("data"), "shared")
    dealt = contexts.repartition("anchor", "chunk").sortWithinPartitions("anchor", "chunk", "doc", "place")
    found = dealt.mapInArrow(_sorted_rows, "hash binary, doc long, place long")
    own = F.when(F.col("hash").isNull(), F.xxhash64("doc", "place"))
    again = W.partitionBy("hash", own).orderBy(*_order())
    found = found.withColumn("earliest", F.rank().over(again) == 1).where("hash IS NULL OR NOT earliest")
    return sure.union(found.select("doc", "place"))


# Removal ---------------------------------------------------------------------------------------------------------


def _runs(places: list[int]) -> list[tuple[int, int]]:
    """Maximal runs covered by places."""
    p = np.array(places, dtype=np.int64)
    start = (p >> 8) & _OFFSET
    end = start + (p & 255)
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    first = np.append(True, start[1:] > reach[:-1])
    return list(zip(start[first].tolist(), reach[np.append(first[1:], True)].tolist(), strict=True))


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        doc_id = batch.column(0)
        for a in range(0, batch.num_rows, 512):
            sizes, spans, kept = [], [], []
            part = batch.slice(a, 512)
            for data, places in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                runs = _runs(places) if places else []
                sizes.append(len(data))
                spans.append([{"start": x, "end": y} for x, y in runs])
                kept.append(b"".join(data[x:y] for x, y in zip([0] + [y for _, y in runs], [x for x, _ in runs] + [len(data)], strict=True)))
            arrays = [doc_id.slice(a, 512), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "spans", "kept"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for every row: its repeated byte runs, maximal and in order, and the bytes left.

    A byte is a repeat if a string of LENGTH bytes over it also starts earlier: in a document before it, or further up in the
    same one; overlaps count, and no string reaches from one document into the next.  ``docs`` has doc_id and text; other
    columns are left aside.  Null texts are empty.  Rows without an id come before all others, ordered by a hash of their
    text, and rows of one id with different texts are different documents, ordered by a hash too.  Rows with the same
    id and text (or no id and the same text) are one document: each gets its result.  An empty table gives no rows.
    Runs jobs at once.
    """
    known = marked(docs)
    mark = F.col("place").bitwiseAND(F.lit(_MARK).cast("long")).alias("mark")
    spans = repeated_spans(known).groupBy("doc", mark).agg(F.collect_list("place").alias("places"))
    joined = known.repartition("doc", "mark").join(spans, ["doc", "mark"], "left")
    slim = joined.select(F.when(F.col("mark") >= 0, F.col("doc")).alias("doc_id"), "data", "places")
    return slim.mapInArrow(_without, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")

"""Best-two-fit packing of tokenised documents into sequences of bounded length.

A bin is filled greedily, the largest fitting piece first.  Then its smallest piece is replaced by the two unpacked
pieces that fill the gap and the smallest piece's room best, if they fill more than that piece did.

Pieces of equal length are interchangeable, so the packing is worked out on the counts of lengths: a table bounded by the
sequence length, whatever the corpus.  As long as no count runs out, the next bin looks like the last one, and is
made as often as the counts allow in one step.  Each piece then finds its bin from its rank among the pieces
of its length.
"""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.interleave import fractional_ranks
from tidemark.llm.memory import give_back
from tidemark.plans.staging import staged

CAPACITY = 2048
#: The id that ends each document.
END = 0
TOKENIZER = "byte_bpe_50k.json"
#: Parts of texts whose ids a worker remembers, and their bytes.
REMEMBERED = 800_000
REMEMBERED_BYTES = 1 << 26
_BATCH_BYTES = 1 << 21

#: Parts that keep their ids between line ends: without one, and without other white space at their ends than one space.
_ALONE = re.compile(r" ?\S(?:[^\n]*\S)?")
_ASCII = np.arange(256)
_WHITE = np.isin(_ASCII, [*range(0x09, 0x0E), *range(0x1C, 0x21)])
_LETTER = np.isin(_ASCII, [ord(c) for c in string.ascii_letters + string.digits])
_SIGN = np.isin(_ASCII, [ord(c) for c in ".,;:!?"])


def _white(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space of any script."""
    white = _WHITE[data]
    for lead, ends in ((0xC2, (b"\x85", b"\xa0")), (0xE1, (b"\x9a\x80",)), (0xE2, _E2_SPACES), (0xE3, (b"\x80\x80",))):
        for at in np.flatnonzero(data == lead).tolist():
            rest = data[at + 1 : at + 3].tobytes()
            for end in ends:
                if rest.startswith(end):
                    white[at : at + 1 + len(end)] = True
    return white


_E2_SPACES = tuple(chr(c).encode()[1:] for c in (*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F))


def part_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places where texts that lie behind one another can be taken apart without changing their ids; text starts included.

    Byte-level BPE never joins across a space between characters other than white space (the space goes with what
    follows), across a line end between such, or from a letter or digit to a sign.  Letters beyond ASCII are only known for
    the two-byte ones of Latin-1.
    """
    n = len(data)
    cut = np.zeros(n + 1, dtype=bool)
    cut[starts] = True
    if n > 2:
        first = cut[:n].copy()
        dark = ~_white(data)
        lone = np.zeros(n, dtype=bool)
        lone[1:-1] = dark[:-2] & dark[2:] & ~first[1:-1] & ~first[2:]
        space, line = lone & (data == 0x20), lone & (data == 0x0A)
        cut[:n] |= space | line
        cut[1:] |= line
        letter = _LETTER[data]
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7) & (data[1:] >= 0x80)
        cut[1:n] |= _SIGN[data[1:]] & letter[:-1]
    return np.flatnonzero(cut[:n])


class PartTokenizer:
    """Ids of texts by way of a memory of their parts: each different part is tokenised once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.line_end,) = self._encoded(["\n"])[0]
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.pool = np.empty(1 << 20, dtype="<u4")
        self.begin = np.empty(1 << 16, dtype=np.int64)
        self.size = np.empty(1 << 16, dtype=np.int64)
        self.used = self.held = 0

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, parts: list[bytes], ids: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        have, known = len(self.number), len(self.number) + len(parts)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while known > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.empty_like(x)]) for x in (self.begin, self.size))
        self.pool[self.used : self.used + len(ids)] = ids
        self.begin[have:known], self.size[have:known] = begin + self.used, size
        self.number |= zip(parts, range(have, known), strict=True)
        self.used += len(ids)
        self.held += sum(map(len, parts))

    def _learn(self, parts: list[bytes]) -> None:
        texts = {p: p.decode() for p in parts}
        lined = [p for p, t in texts.items() if _ALONE.fullmatch(t)]
        for at in range(0, len(lined), 2048):
            some = lined[at : at + 2048]
            ids = np.array(self._encoded(["\n".join(texts[p] for p in some)])[0], dtype="<u4")
            ends = np.flatnonzero(ids == self.line_end)
            begin = np.append(0, ends + 1)
            self._keep(some, ids, begin, np.append(ends, len(ids)) - begin)
        others = list(set(parts).difference(lined))
        for at in range(0, len(others), 2048):
            some = others[at : at + 2048]
            found = self._encoded([texts[p] for p in some])
            size = np.array([len(x) for x in found], dtype=np.int64)
            self._keep(some, np.array([x for f in found for x in f], dtype="<u4"), np.cumsum(size) - size, size)

    def flat(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): ids of texts that lie behind one another, and where each text's ids end."""
        starts = part_starts(data, offsets[:-1][np.diff(offsets) > 0])
        bounds = np.append(starts, len(data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        parts = coded.dictionary.to_pylist()
        if len(self.number) + len(parts) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self._forget()
        new = [p for p in parts if p not in self.number]
        if new:
            self._learn(new)
        if not parts:
            return np.empty(0, "<u4"), np.zeros(len(offsets) - 1, dtype=np.int64)
        own = np.fromiter(map(self.number.__getitem__, parts), dtype=np.int64, count=len(parts))
        which = own[coded.indices.to_numpy()]
        lengths = self.size[which]
        upto = np.cumsum(lengths)
        places = np.repeat(self.begin[which] - upto + lengths, lengths) + np.arange(upto[-1])
        before = np.append(0, upto)
        return self.pool[places], before[np.searchsorted(bounds, offsets[1:], side="left")]


_workers: dict[str, PartTokenizer] = {}


def _tokenizer(path: str | None) -> PartTokenizer:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if path not in _workers:
        _workers[path] = PartTokenizer(path)
    return _workers[path]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_END_BYTES = END.to_bytes(4, "little")


def _slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row behind the last, bytes, offsets) of some rows at a time, of about _BATCH_BYTES or one text."""
    texts = column.fill_null("").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + _BATCH_BYTES, side="right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def _pieces(batches: Iterator[pa.RecordBatch], path: str | None, capacity: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    tokenizer = _tokenizer(path)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * keep_ids
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for low, high, data, offsets in _slices(batch.column(1)):
            flat, ends = tokenizer.flat(data, offsets)
            raw, rows, begin = flat.tobytes(), [], 0
            for doc_id, end in zip(ids[low:high], ends.tolist(), strict=True):
                total = end - begin + 1
                first = (total - 1) % capacity + 1
                cuts = [0, *range(first, total + 1, capacity)]
                for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    part = raw[4 * (begin + a) : 4 * min(begin + b, end)] + (_END_BYTES if b == total else b"")
                    rows.append((doc_id, n, a, b - a, zlib.crc32(part)) + (part,) * keep_ids)
                begin = end
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
    give_back()


def token_pieces(
    docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's ids, END included; ``ids`` too if asked.

    A document longer than ``capacity`` is cut; all its pieces but the first are full.  Null texts are empty and give one
    piece, END alone.  ``path`` names a tokenizer file that tasks can open; by default the installed public one.
    """
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = _PIECES + ", ids binary" * keep_ids
    return slim.mapInArrow(partial(_pieces, path=path, capacity=capacity, keep_ids=keep_ids), schema)


@dataclass(frozen=True)
class Plan:
    """Blocks of equal bins, by length and rank: pieces of ``length`` from rank ``first`` on, ``each`` in every bin."""

    length: np.ndarray
    first: np.ndarray
    each: np.ndarray
    bin: np.ndarray
    offset: np.ndarray
    bins: int


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The bins for so many pieces of each length from 1 to ``capacity``."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    place = np.arange(capacity + 1)
    used = np.zeros(capacity + 1, dtype=np.int64)
    rows, bins = [], 0
    while left.any():
        gap, filled = capacity, {}
        free = left.copy()
        top = int(np.flatnonzero(free)[-1])
        while top:
            take = min(int(free[top]), gap // top)
            filled[top] = take
            free[top] -= take
            gap -= take * top
            below = np.flatnonzero(free[: min(top - 1, gap) + 1]) if gap else place[:0]
            top = int(below[-1]) if len(below) else 0
        chosen = dict(filled)
        if gap:
            least = min(filled)
            room = gap + least
            last = np.maximum.accumulate(np.where(free > 0, place, 0))
            one = np.flatnonzero(free[: room + 1])
            two = np.minimum(one, room - one)
            lone = (two == one) & (free[one] < 2)
            two = last[np.where(lone, two - 1, two)]
            both = np.where(two > 0, one + two, 0)
            if len(both) and both.max() > least:
                best = int(np.flatnonzero(both == both.max())[-1])
                chosen[least] -= 1
                for x in (int(one[best]), int(two[best])):
                    chosen[x] = chosen.get(x, 0) + 1
        chosen = {x: n for x, n in chosen.items() if n}
        times = min((int(left[x]) - max(n, filled.get(x, 0))) // n + 1 for x, n in chosen.items())
        offset = 0
        for x in sorted(chosen, reverse=True):
            rows.append((x, used[x], chosen[x], bins, offset))
            offset += x * chosen[x]
            used[x] += chosen[x] * times
            left[x] -= chosen[x] * times
        bins += times
    columns = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return Plan(*columns.T, bins)


def _placed(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    blocks = plan.length * (1 << 48) + plan.first
    for batch in batches:
        length, rank = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("length", "rank"))
        at = np.searchsorted(blocks, length * (1 << 48) + rank, side="right") - 1
        q = rank - plan.first[at]
        rest = [n for n in batch.schema.names if n != "rank"]
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(batch.schema.get_field_index(n)) for n in rest],
                pa.array(plan.bin[at] + q // plan.each[at], pa.int64()),
                pa.array(plan.offset[at] + q % plan.each[at] * length, pa.int64()),
            ],
            [*rest, "sequence_id", "offset"],
        )


def packed(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; lengths are from 1 to ``capacity``.

    At most ``capacity`` counts come to the driver and a plan of a few times that many rows goes to the tasks.  Pieces
    are ranked by Spark in many ranges for each length, so a common length is no hot spot.  Columns named like the results
    are replaced; no pieces give no rows.
    """
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}
    if counts and not 1 <= min(counts) <= max(counts) <= capacity:
        raise ValueError(f"pieces must have lengths from 1 to {capacity}")
    plan = best_two_fit(counts, capacity)
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset", "rank")]
    ranked = fractional_ranks(pieces.select(*kept), "length", list(order))
    ranked = ranked.select("row.*", F.col("rank").cast("long").alias("rank"))
    schema = T.StructType([f for f in ranked.schema if f.name != "rank"]).add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(partial(_placed, plan=plan), schema)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): each sequence's ids as little-endian bytes, from placed pieces with their ids.

    A group is one sequence, of bounded length.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    joined = F.array_join(F.transform(parts, lambda x: x["ids"]), "")
    return placed.groupBy("sequence_id").agg(F.unhex(joined).alias("ids"))


def packed_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, **columns: str) -> DataFrame:
    """Tokenise, cut and pack ``docs``: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Tokenised once: pieces without their ids, a few numbers each, are written and read for counting, ranking and placing.
    Rows without an id and repeated rows are packed like others; an empty table gives an empty result.
    """
    pieces = staged(token_pieces(docs, capacity, path, **columns), "packing-pieces")
    return packed(pieces, capacity, ("doc_id", "piece", "ids_crc32"))

"""Conversation structure repair: cheapest edits that leave a conversation as turns of user and assistant.

A conversation is a lattice: one layer for each row still to come and, in each, four states of the turns written so
far (none, a system turn, a user turn last, an assistant turn last).  Keeping, changing a role, deleting and inserting
are arcs with whole costs.  The auction algorithm for shortest paths finds the prices: a path grows from its origin
along the cheapest arc, and where that costs more than the node's price, the price rises and the path gives the node
up.  Origins are taken from the last layer to the first, and a path ends where it meets a node whose price is
settled, so the work grows with the number of rows.  In the end every arc on a cheapest path is tight (price = cost +
next price), and the first letters among tight arcs spell the least of all cheapest edits.

A row travels as one letter, its role's initial and its fault.  Copies are counted before the shuffle, and a
conversation's letters are sorted in ranges of rows, so that a conversation with most of the rows is spread over tasks;
what meets in one place is one letter a row, like the edits themselves.  The texts follow once, sorted behind their
edits, and are streamed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.staging import staged

RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROWS_PER_RANGE = 20_000
WHITE = " \t\n\x0b\x0c\r"

#: Letters of a row: role initial (s, u, a, other) by fault.
SOUND, CUT, BLANK, REPEATED = "suao", "SUAO", "1234", "5678"
_LEGAL = {"su", "ua", "au"}
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
_NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_ANSWER = (2, 2, 3, 2)
_ENDS = (0, 3)
_ROLE = {2: "user", 3: "assistant"}


def _arcs(letter: str | None, state: int) -> list[tuple[str, int, int, int]]:
    """(edit, cost, layers on, next state) of the arcs from a state before a row, in the order of their letters."""
    insert = ("I", INSERT, 0, _ANSWER[state])
    if letter is None:
        return [insert]
    arcs = [("D", DELETE, 1, state), insert]
    if letter in SOUND + CUT:
        more = TRUNCATED if letter in CUT else 0
        onto = _NEXT[state].get(letter.lower())
        if onto is not None:
            arcs.append(("K", more, 1, onto))
        arcs.append(("R", RENAME + more, 1, _ANSWER[state]))
    return arcs


_ARCS = {c: [_arcs(c, q) for q in range(4)] for c in SOUND + CUT + BLANK + REPEATED} | {None: [_arcs(None, q) for q in range(4)]}


def prices(letters: str) -> list[int]:
    """The cost to the end from each node (4 * layer + state), by auction."""
    n = len(letters)
    price, settled = [0] * (4 * n + 4), bytearray(4 * n + 4)
    for state in _ENDS:
        settled[4 * n + state] = 1
    for origin in range(4 * n + 3, -1, -1):
        path = [origin]
        while not settled[path[-1]]:
            here = path[-1]
            layer, state = divmod(here, 4)
            best, onto = None, here
            for _, cost, on, to in _ARCS[letters[layer] if layer < n else None][state]:
                there = 4 * (layer + on) + to
                if best is None or cost + price[there] < best:
                    best, onto = cost + price[there], there
            if price[here] < best:
                price[here] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(onto)
        for node in path:
            settled[node] = 1
    return price


def cheapest_edits(letters: str) -> tuple[int, str]:
    """The least cost and, of the edits that have it, the ASCII-least."""
    if len(letters) > 64:
        return _traced(letters)
    return _remembered(letters)


def _traced(letters: str) -> tuple[int, str]:
    price, n = prices(letters), len(letters)
    layer = state = 0
    edits = []
    while layer < n or state not in _ENDS:
        for edit, cost, on, to in _ARCS[letters[layer] if layer < n else None][state]:
            if price[4 * layer + state] == cost + price[4 * (layer + on) + to]:
                edits.append(edit)
                layer, state = layer + on, to
                break
    return price[0], "".join(edits)


_remembered = lru_cache(1 << 16)(_traced)


def _count(letters: str, among: str) -> int:
    return sum(map(letters.count, among))


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    types = [pa.int64()] * 7 + [pa.string()]
    plain = str.maketrans(CUT + BLANK + REPEATED, SOUND * 3)
    for batch in batches:
        rows = []
        for conv_id, letters, gaps in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "letters", "gaps")), strict=True):
            initials = letters.translate(plain)
            illegal = sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False))
            faults = [_count(letters, among) for among in (BLANK, REPEATED, CUT)]
            rows.append((conv_id, gaps, *faults, illegal, *cheapest_edits(letters)))
        columns = zip(*rows, strict=True) if rows else [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _shown(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def _plain_rows(conversations: DataFrame, copies: str | None) -> DataFrame:
    """Rows with the hash of their text and how often each occurs."""
    often = F.lit(1) if copies is None else F.col(copies)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _shown("role").alias("role"),
        _shown("text").alias("text"), often.cast("long").alias("copies"),
    )
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def _joined(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """``a`` with the row of ``b`` that has the same keys, nulls being equal; ``b`` has each once."""
    return a.alias("a").join(b.alias("b"), F.expr(" AND ".join(f"a.{k} <=> b.{k}" for k in keys)), "left")


def _letters(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, n, code): different rows, how often they occur, and the letters they stand for."""
    body = F.rtrim(F.col("text"), F.lit(WHITE))
    kind = F.when(body == "", 0).when(F.substring(body, -1, 1).isin(".", "!", "?"), 2).otherwise(1)
    counted = rows.withColumn("kind", kind).groupBy("conv_id", "role", "digest", "turn", "kind").agg(F.sum("copies").alias("n"))
    firsts = counted.where("n > 0 AND kind > 0").groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("at"))
    firsts = firsts.select("conv_id", "role", "digest", F.col("at.turn").alias("turn"), F.lit(True).alias("leads"))
    found = _joined(counted, firsts, "conv_id", "role", "digest", "turn").select("a.*", "b.leads")
    at = F.position(F.substring("role", 1, 1), F.lit("sua"))
    at = F.when((F.col("role") == "") | (at == 0), 4).otherwise(at)
    letter = lambda table: F.substring(F.lit(table), at, F.lit(1))
    n = F.col("n").cast("int")
    lead = F.when(F.col("kind") == 2, letter(SOUND)).otherwise(letter(CUT))
    code = (
        F.when(n == 0, "")
        .when(F.col("kind") == 0, F.repeat(letter(BLANK), n))
        .when(F.col("leads"), F.concat(lead, F.repeat(letter(REPEATED), n - 1)))
        .otherwise(F.repeat(letter(REPEATED), n))
    )
    return found.select("conv_id", "turn", "role", "digest", "n", code.alias("code"))


def audits(conversations: DataFrame, copies: str | None = None) -> DataFrame:
    """One row for each conv_id: gaps, blank, duplicate, truncated, illegal, cost and audit.

    ``conversations`` has conv_id, turn, role and text; other columns are left aside.  ``copies`` names a column that
    says how often a row stands there (0: it is gone, but its conversation is still listed), without it each does once.  Rows go by turn, nulls first; rows of one
    turn by role and then by the SHA-256 of their text.  A null role or text is one space, so a null text is blank and a
    null role is none of the known ones; rows without conv_id are one conversation.  An empty table gives no rows.
    """
    coded = staged(_letters(_plain_rows(conversations, copies)), "repair-letters")
    parts = max(1, math.ceil(coded.count() / ROWS_PER_RANGE))
    ranged = coded.repartitionByRange(parts, "conv_id", "turn", "role", "digest").withColumn("part", F.spark_partition_id())
    spelt = lambda *by: F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct(*by, "code"))), lambda x: x["code"]), ""
    )
    pieces = ranged.groupBy("conv_id", "part").agg(spelt("turn", "role", "digest").alias("code"))
    whole = pieces.groupBy("conv_id").agg(spelt("part").alias("letters"))
    turns = coded.where("n > 0 AND turn IS NOT NULL").select("conv_id", "turn").distinct()
    held = turns.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    known = _joined(whole, held, "conv_id").select("a.*", F.coalesce("gaps", F.lit(0).cast("long")).alias("gaps"))
    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    return known.mapInArrow(_audit, schema)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator]]:
    """(edit, role, text) of each conversation's repaired turns, one after another; (None, None, head) starts one."""
    edits, state = iter(""), 0

    def upto_row():
        nonlocal state
        for edit in edits:
            if edit != "I":
                yield edit, None, None
                return
            state = _ANSWER[state]
            yield "I", _ROLE[state], ""

    for batch in batches:
        for row in batch.to_pylist():
            if row["text"] is None:
                yield from upto_row()
                edits, state = iter(row["audit"]), 0
                yield None, None, row
                continue
            for _ in range(row["copies"]):
                for edit, role, text in upto_row():
                    if edit == "I":
                        yield edit, role, text
                    elif edit == "K":
                        state = _NEXT[state][row["role"][0]]
                        yield edit, row["role"], row["text"]
                    elif edit == "R":
                        state = _ANSWER[state]
                        yield edit, _ROLE[state], row["text"]
    yield from upto_row()


def _as_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    conv_id, position, rows, size = None, 0, [], 0
    for edit, role, text in _turns(batches):
        if edit is None:
            conv_id, position = text["conv_id"], 0
            continue
        rows.append({"conv_id": conv_id, "position": position, "edit": edit, "role": role, "text": text})
        position, size = position + 1, size + len(text)
        if size > 1 << 22 or len(rows) == 10_000:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def _as_digests(batches: Iterator[pa.RecordBatch], kept: list[str]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(c, pa.string() if c == "audit" else pa.int64()) for c in kept] + [("repaired_sha256", pa.string())])
    rows, head, digest, first = [], None, None, True

    def done():
        rows.append({c: head[c] for c in kept} | {"repaired_sha256": digest.hexdigest()})

    for edit, role, text in _turns(batches):
        if edit is None:
            if head is not None:
                done()
            head, digest, first = text, hashlib.sha256(), True
            if len(rows) == 10_000:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
            continue
        digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
        first = False
    if head is not None:
        done()
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def _behind_audits(conversations: DataFrame, copies: str | None, found: DataFrame) -> DataFrame:
    """Rows of each conversation in order, behind a row with its edits (the one whose text is null)."""
    rows = _plain_rows(conversations, copies).where("copies > 0")
    order = ["turn", "role", "digest"]
    heads = found.withColumns({"behind": F.lit(0)} | {c: F.lit(None).cast(rows.schema[c].dataType) for c in [*order, "text", "copies"]})
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema if f.name != "conv_id"]
    both = heads.unionByName(rows.select("*", F.lit(1).alias("behind"), *empty))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "behind", *order).drop("digest", "turn", "behind")


def repaired(conversations: DataFrame, copies: str | None = None) -> DataFrame:
    """(conv_id, position, edit, role, text): the repaired turns of every conversation, from position 0.

    ``edit`` is K for a turn kept, R for one with a new role and I for one put in.  Conversations left without turns give
    no rows; the rest is as in ``audits``.
    """
    found = staged(audits(conversations, copies), "repair-audits")
    return _behind_audits(conversations, copies, found).mapInArrow(_as_rows, "conv_id long, position long, edit string, role string, text string")


def repaired_digests(conversations: DataFrame, copies: str | None = None) -> DataFrame:
    """``audits`` with the SHA-256 of the repaired turns, ``role:text`` joined by line ends, which is taken as they stream by."""
    found = staged(audits(conversations, copies), "repair-audits")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
    return _behind_audits(conversations, copies, found).mapInArrow(partial(_as_digests, kept=found.columns), f"{schema}, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults put in by the CRC-32 of ``conv_id:turn`` modulo 20, and ``copies``, how often each stands there.

    0 drops a row, 1 empties its text, 2 removes its ``.``, ``!`` and ``?``, 3 repeats it, 4 makes its role user.  Nulls
    count as one space.
    """
    fault = F.crc32(F.concat(_shown("conv_id"), F.lit(":"), _shown("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(_shown("text"), ".!?", "")).otherwise(_shown("text"))
    return conversations.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(_shown("role")).alias("role"), text.alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )

"""Conversation repair against a plain search over all edits."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from tidemark.llm import auction_repair as ar

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_edits(rows: list[tuple[str, str, bool]]) -> tuple[int, str]:
    """(cost, audit) of rows (role initial, fault, truncated) by relaxing (cost, letters) of every state until nothing changes."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    answer = {0: 2, 1: 2, 2: 3, 3: 2}
    best = {(len(rows), 0): (0, ""), (len(rows), 3): (0, "")}
    for k in range(len(rows), -1, -1):
        changed = True
        while changed:
            changed = False
            for q in range(4):
                options = [(3, "I", (k, answer[q]))]
                if k < len(rows):
                    role, gone, cut = rows[k]
                    options.append((4, "D", (k + 1, q)))
                    if not gone:
                        options.append((3 + 3 * cut, "R", (k + 1, answer[q])))
                        if (q, role) in step:
                            options.append((3 * cut, "K", (k + 1, step[q, role])))
                for cost, letter, to in options:
                    if to in best and not (k == len(rows) and q in (0, 3)):
                        found = (cost + best[to][0], letter + best[to][1])
                        if (k, q) not in best or found < best[k, q]:
                            best[k, q], changed = found, True
    return best[0, 0]


def plain_repair(conversation: list[tuple]) -> dict:
    """The contract's row of one conversation of (conv_id, turn, role, text), damage included."""
    after = []
    for conv_id, turn, role, text in conversation:
        role, text = (" " if v is None else v for v in (role, text))
        fault = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        after += [(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, rows, n = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in after:
        body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        kind = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        if kind:
            n[kind] += 1
        rows.append((role[:1], kind in ("blank", "duplicate"), kind == "truncated"))
    cost, audit = plain_edits(rows)
    state, lines, at = 0, [], 0
    for edit in audit:
        answer = {0: 2, 1: 2, 2: 3, 3: 2}[state]
        if edit == "I":
            state = answer
            lines.append({2: "user:", 3: "assistant:"}[state])
            continue
        _, role, text = after[at]
        at += 1
        if edit == "K":
            state = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}[state, role[0]]
            lines.append(f"{role}:{text}")
        elif edit == "R":
            state = answer
            lines.append({2: "user", 3: "assistant"}[state] + ":" + text)
    turns = {t for t, _, _ in after if t is not None}
    initials = [r[0] for r in rows]
    return n | {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def made(seed: int) -> list[tuple]:
    draw = random.Random(seed)
    texts = ["Yes.", "Yes.", "No!", "Why?", "open end", "", " \t\n", "Fine. \n ", "a.\x0b", None, "long " * 50 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    rows = []
    for conv in range(300):
        start = draw.choice([0, 0, 5])
        for turn in range(start, start + draw.choice([1, 2, 5, 9, 14])):
            role = ("user", "assistant")[turn % 2] if draw.random() < 0.7 else draw.choice(roles)
            text = f"Line {draw.randrange(40)}." if draw.random() < 0.6 else draw.choice(texts)
            rows += [(conv, turn if draw.random() < 0.97 else None, role, text)] * (2 if draw.random() < 0.05 else 1)
    rows += [(900, t, ("user", "assistant")[t % 2], draw.choice(texts)) for t in range(400)]
    rows += [(901, 1, "user", "the same again.")] * 500
    rows += [(None, t, "user", f"no id {t}.") for t in range(6)] + [(902, None, None, None)]
    draw.shuffle(rows)
    return rows


def by_conversation(rows: list[tuple]) -> dict:
    out: dict = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("rows_per_range", [ar.ROWS_PER_RANGE, 37])
def test_against_plain_search(spark, monkeypatch, rows_per_range):
    """Also with conversations that lie in many ranges."""
    monkeypatch.setattr(ar, "ROWS_PER_RANGE", rows_per_range)
    rows = made(3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = {r["conv_id"]: r.asDict() for r in ar.repaired_digests(ar.damaged(df), copies="copies").collect()}
    want = {k: plain_repair(v) | {"conv_id": k} for k, v in by_conversation(rows).items()}
    assert got == want


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hello."), (1, 1, "user", "Hello."), (1, 2, "user", "More?"), (1, 3, "assistant", "cut"), (2, 0, "system", "Be kind.")]
    got = ar.repaired(spark.createDataFrame([r + ("x",) for r in rows], SCHEMA + ", copies string")).collect()
    kept = sorted((r.position, r.edit, r.role, r.text) for r in got if r.conv_id == 1)
    assert kept == [(0, "K", "user", "Hello."), (1, "I", "assistant", ""), (2, "K", "user", "More?"), (3, "K", "assistant", "cut")]
    one = [r for r in ar.audits(spark.createDataFrame(rows, SCHEMA)).collect() if r.conv_id == 1][0]
    assert (one.cost, one.audit) == plain_edits([("u", False, False), ("u", True, False), ("u", False, False), ("a", False, True)])
    assert all(r.conv_id != 2 for r in got)


def test_prices_are_distances():
    """Converged prices satisfy every arc, and the path from each node is tight."""
    draw = random.Random(1)
    for _ in range(300):
        letters = "".join(draw.choice(ar.SOUND + ar.CUT + ar.BLANK + ar.REPEATED) for _ in range(draw.randrange(12)))
        price = ar.prices(letters)
        for layer in range(len(letters) + 1):
            for state in range(4):
                if layer == len(letters) and state in (0, 3):
                    continue
                arcs = ar._ARCS[letters[layer] if layer < len(letters) else None][state]
                assert price[4 * layer + state] == min(c + price[4 * (layer + on) + to] for _, c, on, to in arcs)


def test_empty_and_long(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ar.repaired_digests(ar.damaged(empty), copies="copies").count() == 0 and ar.repaired(empty).count() == 0
    n = 100_000
    cost, audit = ar.cheapest_edits("ua" * (n // 2))
    assert cost == 0 and audit == "K" * n
    assert ar.cheapest_edits("u8" * 300) == plain_edits([("u", False, False), ("u", True, False)] * 300)

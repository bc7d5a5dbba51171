from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}" for a in "tharionelbomu" for b in ("an", "es", "or", "ti", "el", "ou", "ré")]


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    words = [draw.choice(WORDS) + draw.choice(WORDS) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 12]).capitalize() + "." for i in range(0, n, 12))


def edited(text: str, seed: int, share: float) -> str:
    draw = random.Random(seed)
    return " ".join(f"x{draw.randrange(10**6)}" if draw.random() < share else w for w in text.split(" "))


def odd_rows() -> list[tuple]:
    """Null and empty texts, null ids, ties, repeated rows, a hot group of copies, near copies, and a very long text."""
    rows = [
        (0, None, "en", "a", None),
        (1, "", "en", "a", 0),
        (2, " \n\t ", None, "a", 4),
        (3, "one two", "en", "b", 7),
        (3, "one two", "en", "b", 7),
        (None, "no id but text " * 20, "en", None, 300),
        (None, None, None, None, None),
        (4, "ONE two", "en", "b", 7),
        (5, prose(5, 30_000), "en", "c", 1),
    ]
    base = prose(1, 150)
    rows += [(10 + i, base, "en", "hot", len(base)) for i in range(30)]
    for i in range(30):
        near = edited(base, i, 0.01 + 0.004 * (i % 12))
        rows.append((50 + i, near, "en", "hot", len(near)))
    rows += [(100 + i, prose(100 + i, 60 + 7 * i), "de", f"s{i % 4}", 1) for i in range(40)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

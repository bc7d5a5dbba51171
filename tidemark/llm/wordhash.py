"""Vectorised hashes of words and of word shingles, for numpy code inside Spark tasks.

A word is a run of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text.  Its hash is a polynomial over a
table of byte values, taken modulo 2**64 from running sums and then mixed, so that a whole batch of texts is
hashed with a few array operations.  Hashes depend on nothing but the word, in any process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_MASK = (1 << 64) - 1
#: Texts are hashed in blocks of about so many bytes, so that memory is bounded whatever their length.
BLOCK_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64: every input bit reaches every output bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE_VALUES = mix(np.arange(1, 257, dtype=U) * U(_BASE))
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, as every block needs them."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK_BYTES + 1024), base, dtype=U)
        steps[0] = 1
        have = np.cumprod(steps, dtype=U)
        if n <= 4 * BLOCK_BYTES:
            _powers[base] = have
    return have[:n]


def _hash_block(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of the words of one block of lower-cased bytes."""
    space = _IS_SPACE[data]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return starts, np.empty(0, dtype=U)
    sums = np.empty(len(data) + 1, dtype=U)
    sums[0] = 0
    np.cumsum(_BYTE_VALUES[data] * _power(_BASE, len(data)), dtype=U, out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * _power(_INVERSE, len(data))[starts] + (ends - starts).astype(U))


def _blocks(data: bytes) -> Iterator[bytes]:
    """Cuts at white space, at least BLOCK_BYTES apart."""
    at = 0
    while len(data) - at > BLOCK_BYTES:
        cut = at + BLOCK_BYTES
        while cut < len(data) and not _IS_SPACE[data[cut]]:
            cut += 1
        yield data[at:cut]
        at = cut
    yield data[at:]


def word_blocks(texts: list[str | None], lower: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word hashes of the texts, several texts a block: (hashes, offsets); None has no words.

    Text ``i`` of a block has the words ``hashes[offsets[i]:offsets[i + 1]]``; blocks follow the order of the texts.
    A text longer than BLOCK_BYTES is hashed piece by piece and is a block of its own.
    """
    held: list[bytes] = []
    size = 0

    def flush():
        joined = np.frombuffer(b" ".join(held), dtype=np.uint8)
        starts, hashes = _hash_block(_LOWER[joined] if lower else joined)
        ends = np.cumsum([0] + [len(x) + 1 for x in held])
        return hashes, np.searchsorted(starts, ends)

    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(data) > BLOCK_BYTES:
            yield flush()
            held, size = [], 0
        if len(data) > BLOCK_BYTES:
            parts = [np.frombuffer(b, dtype=np.uint8) for b in _blocks(data)]
            hashes = np.concatenate([_hash_block(_LOWER[p] if lower else p)[1] for p in parts])
            yield hashes, np.array([0, len(hashes)])
            continue
        held.append(data)
        size += len(data) + 1
    if held:
        yield flush()


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` words, in order; its length follows the words' order and number."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, dtype=U)
    out = np.full(n, width, dtype=U)
    for i in range(width):
        out += words[i : i + n] * _FACTORS[i]
    return mix(out)


_FACTORS = mix(np.arange(1, 17, dtype=U) * U(0xD6E8FEB86659FD93)) | U(1)


def shingle_sets(texts: list[str | None], width: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's ``width``-word shingles.

    A text of fewer words is one shingle of all its words; a text without words has none.
    """
    for words, offsets in word_blocks(texts):
        runs = windows(words, width)
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if b - a >= width:
                found = np.sort(runs[a : b - width + 1])
                keep = np.empty(len(found), dtype=bool)
                keep[0] = True
                np.not_equal(found[1:], found[:-1], out=keep[1:])
                yield found[keep]
            elif b > a:
                yield windows(words[a:b], b - a)
            else:
                yield np.empty(0, dtype=U)

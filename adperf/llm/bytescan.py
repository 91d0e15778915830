"""Vectorised text scanning with numpy, used inside Arrow tasks.

A task gets Arrow batches and cuts them into chunks of whole documents of about ``CHUNK``
bytes (a longer document is a chunk of its own), so working memory follows the longest
document, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19
U64 = np.uint64
_rng = np.random.default_rng(20240607)
BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=U64) | U64(1)
BASE = U64(0x9E3779B97F4A7C15 | 5)
BASE_INV = U64(pow(int(BASE), -1, 2**64))

# fixed values: byte classes that the word rules name
_ASCII_SPACE = [0x20, *range(0x09, 0x0E)]


def _lowered() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = _lowered()
# words split on ASCII white space, A-Z lowered; 0 marks a separator
SPACE_WORDS = LOWER.copy()
SPACE_WORDS[_ASCII_SPACE] = 0
# words of digits, letters a-z and every non-ASCII character, A-Z lowered
ALNUM_WORDS = np.zeros(256, np.uint8)
for _b in [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    ALNUM_WORDS[_b] = LOWER[_b]


_powers = (np.ones(1, U64), np.ones(1, U64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK + (CHUNK >> 1))
        steps = [np.full(size, b, U64) for b in (BASE, BASE_INV)]
        for s in steps:
            s[0] = 1
        with np.errstate(over="ignore"):
            _powers = tuple(np.cumprod(s) for s in steps)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads the entropy of every input bit over the word."""
    h = np.asarray(h, U64).copy()
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def chunks(text: pa.Array, max_rows: int = 1 << 30
           ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows; null is an empty text."""
    if text.null_count:
        text = pc.fill_null(text, "")
    n = len(text)
    if not n:
        return
    # the batch's own buffers, not a copy
    wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    off = np.frombuffer(text.buffers()[1], np.int64 if wide else np.int32)
    off = off[text.offset:text.offset + n + 1].astype(np.int64)
    data = text.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + CHUNK, side="right")) - 1)
        b = min(b, a + max_rows)
        yield a, b, data[off[a]:off[b]], off[a:b + 1] - off[a]
        a = b


def words(data: np.ndarray, off: np.ndarray, classes: np.ndarray):
    """Start, end and hash of every word, and each document's first word index."""
    n = len(data)
    kind = classes[data]
    inside = kind != 0
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    after[n - 1:] = False
    after[:-1] = inside[1:]
    cuts = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < n)]
    before[cuts] = False
    after[cuts - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(BYTE_CODES[kind] * up[:n], out=sums[1:])
    h = mix((sums[end] - sums[start]) * down[start] ^ (end - start).astype(U64))
    first = np.searchsorted(start, off[:-1])
    return start, end, h, np.append(first, len(start))


def runs_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes (len(h) - k + 1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(k):
        out = out * U64(0xD6E8FEB86659FD93) + h[j:j + n]
    return mix(out ^ U64(k))


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)

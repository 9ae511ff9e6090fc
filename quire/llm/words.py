"""Words of many texts at once as 64-bit hashes, without a Python object per word.

A word's hash is sum(T[byte k] * R^k) mod 2^64 for a seeded table T and odd R, mixed. Prefix
sums give all words of a run of texts in a few array operations.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

BYTES_AT_ONCE = 1 << 22


def groups(texts: Iterable[bytes], limit: int = BYTES_AT_ONCE) -> Iterator[list[bytes]]:
    """Runs of texts of about ``limit`` bytes; a longer text makes a run of its own."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > limit:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


_R = 0x9E3779B97F4A7C15 | 1
_R_INVERSE = pow(_R, -1, 1 << 64)
_T = np.random.Generator(np.random.PCG64(20240131)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_T[32] = 0
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """R^k and R^-k for k < n; kept for runs of the usual size."""
    if _powers and len(_powers[0]) >= n:
        return _powers
    size = max(n, BYTES_AT_ONCE + 65536)
    made = []
    for base in (_R, _R_INVERSE):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    if size <= 4 * BYTES_AT_ONCE:
        _powers[:] = made
    return made


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def hash_words(texts: list[bytes], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, first word of each text plus the total).

    ``table`` is a bytes.translate table that maps every byte of a word to itself (or its
    lower-case form) and every other byte, the line feed among them, to a blank.
    """
    flat = b"\n".join([*texts, b""]).translate(table)
    a = np.frombuffer(flat, np.uint8)
    up, down = _power_tables(len(a))
    blank = a == 32
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if len(a) and not blank[0]:
        edge = np.concatenate([[0], edge])
    begin, end = edge[::2], edge[1::2]  # the last byte is a blank, so every word ends
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_T[a] * up[: len(a)], out=total[1:])
    hashes = mix((total[end] - total[begin]) * down[begin])
    ends = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.concatenate([[0], np.searchsorted(begin, ends)])

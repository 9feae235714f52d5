"""Hashed word shingles of many texts at once, with numpy."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_MASK = (1 << 64) - 1
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _powers[k] = np.multiply.accumulate(factors)
    return _powers[0], _powers[1]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, first byte, end byte) of every word; bytes count from the start of b' '.join(texts). Words are runs of anything but ASCII white space."""
    buffer = b" ".join([*texts, b""]) or b" "
    data = np.frombuffer(buffer, np.uint8)
    blank = _IS_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = _grow(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.searchsorted(offsets, starts, side="right") - 1, starts, ends


def gram_hashes(words: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place of the first word) of every run of ``width`` words of one owner."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    total = np.zeros(n, np.uint64)
    factor = 1
    for k in range(width):
        factor = (factor * int(_BASE) + 2 * k) & _MASK
        total += words[k : k + n] * np.uint64(factor | 1)
    places = np.flatnonzero(owner[:n] == owner[width - 1 :])
    return mix(total[places]), places


def shingle_sets(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, hashes): the distinct shingles of text i, ascending, are hashes[bounds[i]:bounds[i + 1]].

    A text with fewer words than ``width``, but not none, has its whole sequence as one.
    """
    words, owner, _, _ = word_hashes([t.lower() for t in texts])
    grams, places = gram_hashes(words, owner, width)
    who = owner[places]
    n_words = np.bincount(owner, minlength=len(texts))
    first = np.concatenate(([0], np.cumsum(n_words)))
    short = np.flatnonzero((n_words > 0) & (n_words < width))
    if len(short):
        extra = []
        for i in short:
            h = int(n_words[i])
            for w in words[first[i] : first[i + 1]].tolist():
                h = int(mix(np.array([(h * int(_BASE) + w) & _MASK], np.uint64))[0])
            extra.append(h)
        grams, who = np.concatenate([grams, np.array(extra, np.uint64)]), np.concatenate([who, short])
    order = np.lexsort((grams, who))
    grams, who = grams[order], who[order]
    if len(grams):
        fresh = np.concatenate(([True], (grams[1:] != grams[:-1]) | (who[1:] != who[:-1])))
        grams, who = grams[fresh], who[fresh]
    return np.concatenate(([0], np.cumsum(np.bincount(who, minlength=len(texts))))), grams


def slices_by_bytes(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Consecutive ranges whose sizes add up to at most ``most``; a single larger one stands alone."""
    found, at, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            found.append((at, i))
            at, total = i, 0
        total += n
    if at < len(sizes):
        found.append((at, len(sizes)))
    return found


#: What a worker keeps from one task to the next of its kind; a task of another kind lets go of it.
KEPT: list[dict] = []


def few_rows(parts: Iterator, rows: int = 256) -> Iterator:
    """Arrow batches in slices, so that Python holds the texts of a few rows at a time; the memory goes back at the end."""
    for kept in KEPT:
        kept.clear()
    for part in parts:
        for at in range(0, part.num_rows, rows):
            yield part.slice(at, rows)
    tidy()


def tidy() -> None:
    """Gives freed memory back to the system. Workers live on after a task, and the next stage needs the room."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)

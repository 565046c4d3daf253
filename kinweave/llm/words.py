"""Words of whole texts as 64-bit hashes, computed over the bytes of an Arrow batch.

A word is a maximal run of bytes of a class, so texts are never copied into single strings. Hashes are
polynomial over bytes and mixed, the same on every executor. Texts are worked off in pieces of about a
quarter of a megabyte that end between words; a piece grows only if one word is longer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Batches of whole texts of so many rows for Python tasks, unless the session says otherwise."""
    if spark.conf.get(_BATCH_KEY, None) is None:
        spark.conf.set(_BATCH_KEY, str(rows))


def mix(values: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 bits."""
    v = values.astype(np.uint64, copy=True)
    v ^= v >> np.uint64(30)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(27)
    v *= np.uint64(0x94D049BB133111EB)
    v ^= v >> np.uint64(31)
    return v


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Powers:
    up = powers(_BASE, PIECE + 1)
    down = powers(_INVERSE, PIECE + 1)


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse for at least ``n`` bytes; kept only up to a piece's size."""
    if n <= len(_Powers.up):
        return _Powers.up, _Powers.down
    return powers(_BASE, n), powers(_INVERSE, n)


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Alphabet:
    """Which bytes make up words, and the value each stands for (A-Z as a-z where folded)."""

    def __init__(self, member: np.ndarray, fold: bool = True) -> None:
        self.member = member
        folded = np.arange(256)
        if fold:
            folded[65:91] += 32
        self.values = BYTE_VALUES[folded]


def _bytes(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low:high + 1] = True
    return out


#: Runs of anything but space and the control characters tab to carriage return.
SPACED = Alphabet(~_bytes((0x20, 0x20), (0x09, 0x0D)))
#: Runs of digits, letters and all characters beyond ASCII.
ALNUM = Alphabet(_bytes((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)))
#: Runs of letters and all characters beyond ASCII.
LETTERS = Alphabet(_bytes((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; row i is ``bytes[offsets[i]:offsets[i + 1]]``, a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    n = len(column)
    ends = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[ends[0]:ends[-1]], ends - ends[0]


def find_words(data: np.ndarray, offsets: np.ndarray, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds): byte ranges of all words; row i owns words ``bounds[i]:bounds[i + 1]``."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = alphabet.member[data]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    start, stop = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    stop[:-1] &= ~inside[1:] | first[1:n]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, alphabet: Alphabet) -> np.ndarray:
    """64-bit hash of every word."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + PIECE, "right")))
        high = ends[j - 1]
        up, down = power_tables(high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(alphabet.values[data[low:high]] * up[:high - low], out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of ``width`` words; fewer words make one window, none make none."""
    n = len(words)
    if not n:
        return words
    k = min(n, width)
    factors = powers(0xC2B2AE3D27D4EB4F, k + 1)[1:]
    total = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        total += words[j:n - k + 1 + j] * factors[j]
    return mix(total)


def row_groups(offsets: np.ndarray, size: int = PIECE) -> list[tuple[int, int]]:
    """Consecutive row ranges of about ``size`` bytes each, at least one row."""
    out, i, n = [], 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        out.append((i, min(j, n)))
        i = j
    return out


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)

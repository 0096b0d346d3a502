"""Arrow text as byte arrays, and vectorised 64-bit hashes of words and substrings.

A substring hash is the polynomial hash of its bytes modulo 2**64, taken from prefix
sums and finished by a mixer, so any substring of a buffer costs constant time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text handled at once in a task; a longer document is taken alone.
CHUNK_BYTES = 1 << 20


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    content = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return content[bounds[0] : bounds[-1]], bounds - bounds[0]


def row_chunks(bounds: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges of at most ``limit`` bytes, or one row."""
    low, rows = 0, len(bounds) - 1
    while low < rows:
        high = int(np.searchsorted(bounds, bounds[low] + limit, side="right")) - 1
        high = min(max(high, low + 1), rows)
        yield low, high
        low = high


def mix(value: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finisher: every input bit reaches every output bit."""
    value = value ^ (value >> np.uint64(30))
    value = value * np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(27)
    value = value * np.uint64(0x94D049BB133111EB)
    value ^= value >> np.uint64(31)
    return value


class Powers:
    """Powers of the base and of its inverse, extended when a longer text comes."""

    def __init__(self) -> None:
        self.forward = self.backward = np.ones(1, np.uint64)

    def upto(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.forward) <= size:
            length = max(size + 1, CHUNK_BYTES + 1)
            for name, step in (("forward", BASE), ("backward", INVERSE)):
                powers = np.full(length, step, np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=np.uint64))
        return self.forward, self.backward


def prefix_sums(data: np.ndarray, powers: Powers) -> np.ndarray:
    forward, _ = powers.upto(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * forward[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of each ``[start, end)``; equal bytes give equal hashes wherever they stand."""
    _, backward = powers.upto(len(sums))
    value = (sums[end] - sums[start]) * backward[start]
    return mix(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data | np.uint8(32), data)


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes other than space and \\t\\n\\v\\f\\r, within rows."""
    size = len(data)
    inside = np.ones(size + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
    border = np.zeros(size + 1, bool)
    border[bounds] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | border[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | border[1:])) + 1
    return start, end


def word_hashes(data: np.ndarray, bounds: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word in order, and the index of each row's first word (one more at the end)."""
    start, end = word_spans(data, bounds)
    hashes = span_hashes(prefix_sums(data, powers), start, end, powers)
    return hashes, np.searchsorted(start, bounds)


def hash_terms(terms: list[str], powers: Powers | None = None) -> np.ndarray:
    """The hashes that texts give these words."""
    encoded = [t.encode() for t in terms]
    end = np.cumsum([len(e) for e in encoded], dtype=np.int64)
    start = np.concatenate([[0], end[:-1]]).astype(np.int64)
    powers = powers or Powers()
    return span_hashes(prefix_sums(np.frombuffer(b"".join(encoded), np.uint8), powers), start, end, powers)


def lower_latin(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals in lower case; byte positions stay."""
    lowered = lower_ascii(data)
    if len(data) > 1:
        tail = data[1:]
        capital = (data[:-1] == 0xC3) & (tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)
        lowered[1:] = np.where(capital, lowered[1:] | np.uint8(32), lowered[1:])
    return lowered


def letter_spans(lowered: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of ASCII letters and non-ASCII bytes, within rows."""
    spaced = np.where((lowered >= 97) & (lowered <= 122) | (lowered >= 128), lowered, np.uint8(32))
    return word_spans(spaced, bounds)

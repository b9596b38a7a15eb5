"""Vectorised words and word hashes of byte blocks, for Arrow batches.

A word is a run of bytes other than 0x20 and 0x09-0x0D, that is ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SPAN = 1 << 20  # bytes hashed at once
U64 = np.uint64
_ROOT = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def blocks(column, limit: int = SPAN) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Rows [lo, hi) of an Arrow string column as (lo, hi, bytes joined by a space, start of each row).

    Null counts as empty. A block ends once it has ``limit`` bytes.
    """
    parts: list[bytes] = []
    lo = size = 0
    for i, value in enumerate(column):
        parts.append((value.as_buffer().to_pybytes() if value.is_valid else b""))
        size += len(parts[-1]) + 1
        if size >= limit:
            yield lo, i + 1, b" ".join(parts), _starts(parts)
            parts, lo, size = [], i + 1, 0
    if parts:
        yield lo, lo + len(parts), b" ".join(parts), _starts(parts)


def _starts(parts: list[bytes]) -> np.ndarray:
    sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    return np.concatenate(([0], np.cumsum(sizes)[:-1]))


class WordHasher:
    """Polynomial hashes of all words of a block by prefix sums, modulo 2**64, then finalised."""

    def __init__(self, seed: int = 1):
        with np.errstate(over="ignore"):
            self.table = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93) + U64(seed))
        self.size = 0
        self._grow(SPAN + 1)

    def _grow(self, n: int) -> None:
        if n > self.size:
            with np.errstate(over="ignore"):
                one = np.ones(1, U64)
                self.up = np.concatenate((one, np.cumprod(np.full(n, _ROOT, U64))))
                self.down = np.concatenate((one, np.cumprod(np.full(n, pow(_ROOT, -1, 1 << 64), U64))))
            self.size = n

    def words(self, block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of the words of a block."""
        data = np.frombuffer(block, np.uint8)
        solid = np.empty(len(data) + 2, bool)
        solid[0] = solid[-1] = False
        np.not_equal(data, 32, out=solid[1:-1])
        solid[1:-1] &= (data - np.uint8(9)) > 4
        edges = np.flatnonzero(solid[1:] != solid[:-1])
        starts, ends = edges[0::2], edges[1::2]
        hashes = np.empty(len(starts), U64)
        at = 0
        while at < len(starts):
            base = starts[at]
            to = max(at + 1, int(np.searchsorted(ends, base + SPAN, "right")))
            piece = data[base : ends[to - 1]]
            self._grow(len(piece))
            sums = np.zeros(len(piece) + 1, U64)
            np.cumsum(self.table[piece] * self.up[: len(piece)], out=sums[1:])
            s, e = starts[at:to] - base, ends[at:to] - base
            hashes[at:to] = (sums[e] - sums[s]) * self.down[s] + (e - s).astype(U64)
            at = to
        return starts, ends, mix(hashes)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` consecutive word hashes (len - width + 1 of them)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, U64)
    total = np.zeros(n, U64)
    for j in range(width):
        total *= U64(0xC2B2AE3D27D4EB4F)
        total += hashes[j : j + n]
    return mix(total)


def edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block, and which of its bytes belong to words."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = (data != 32) & ((data - np.uint8(9)) > 4)
    turns = np.flatnonzero(solid[1:] != solid[:-1])
    return turns[0::2], turns[1::2], solid[1:-1]

"""64-bit fingerprints: votes of hashes on bits, and blocks of bits."""
from __future__ import annotations

import numpy as np

#: byte value -> eight counters of one byte each, one per bit
_LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)
_STEP = 255                                   # rows that fit a one-byte counter


def bit_votes(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many of each document's hashes set each bit: (documents, 64).
    ``counts`` holds the number of hashes per document, in order."""
    out = np.zeros((len(counts), 64), np.int64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    pieces = -(-n // _STEP)
    doc = np.repeat(np.arange(len(full)), pieces)
    first = np.concatenate(([0], np.cumsum(pieces)[:-1]))
    base = np.concatenate(([0], np.cumsum(n)[:-1]))
    at = base[doc] + (np.arange(len(doc)) - first[doc]) * _STEP
    lanes = _LANES[hashes.astype("<u8").view(np.uint8)].reshape(-1, 8)
    part = np.add.reduceat(lanes, at, axis=0)
    part = part.astype("<u8").view(np.uint8).reshape(-1, 64)
    out[full] = np.add.reduceat(part.astype(np.int64), first, axis=0)
    return out


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprint per document: bits set in over half its hashes."""
    on = 2 * bit_votes(hashes, counts) > counts[:, None]
    return np.packbits(on, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def word_cuts(parts: int) -> list[tuple[int, int]]:
    """(first bit, width) of 64 bits cut into parts of nearly one width."""
    cut = [64 * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cut, cut[1:])]


def ring_mask(parts: list[tuple[int, int]]) -> int:
    return sum(((1 << w) - 1) << a for a, w in parts)


def signed(x: int) -> int:
    """An unsigned 64-bit value as Spark's long."""
    return x - (1 << 64) if x >> 63 else x

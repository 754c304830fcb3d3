"""Vectorised word and line tables over UTF-8 text (numpy helpers).

A block of documents is one byte buffer; words, lines and their hashes come
from a handful of array passes, with no Python loop per word. Words are the
maximal runs of characters other than ``\\x20`` and ``\\x09-\\x0D``: these
separators are ASCII, so UTF-8 text can be cut at the byte level.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

SEP = np.zeros(256, bool)
SEP[[0x20, *range(0x09, 0x0E)]] = True
NEWLINE = 0x0A
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15                      # odd, so it has an inverse mod 2^64
_BASE_INV = pow(BASE, -1, 1 << 64)
_pows: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) mod 2^64, kept up to a block's length."""
    have = _pows.get(base)
    if have is None or len(have) < n:
        a = np.full(max(n, 1), np.uint64(base), np.uint64)
        a[0] = 1
        have = np.multiply.accumulate(a)
        if n <= 2 * BLOCK_BYTES:
            _pows[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut an Arrow string array into blocks of whole documents of about
    ``limit`` bytes: (index of the first document, bytes, offsets). Nulls are
    empty texts. A longer document is a block of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, off_buf, data = texts.buffers()
    off = np.frombuffer(off_buf, np.int64, n + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(off, off[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, raw[off[a]:off[b]], off[a:b + 1] - off[a]
        a = b


def spans(buf: np.ndarray, inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside`` bytes that don't
    cross a document border."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = off[(off > 0) & (off < len(buf))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def code_points(buf: np.ndarray) -> np.ndarray:
    """Running count of code points: entry i counts those before byte i."""
    out = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=out[1:])
    return out


def rolling(buf: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash of a buffer."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _powers(BASE, len(buf)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, from the prefix sums."""
    if not len(prefix) or not len(start):
        return np.zeros(len(start), np.uint64)
    h = (prefix[end] - prefix[start]) * _powers(_BASE_INV, len(prefix))[start]
    return mix(h + (end - start).astype(np.uint64))


def doc_of(off: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which document of the block each byte position belongs to."""
    return np.searchsorted(off, start, "right") - 1


def ngram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on (len - n + 1 of them)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = words[:m].copy()
    for j in range(1, n):
        h *= np.uint64(BASE)
        h += words[j:j + m]
    return h


def duplicated(keys: np.ndarray) -> np.ndarray:
    """Mask of the keys that occur twice or more."""
    s = np.sort(keys)
    dup = s[1:][s[1:] == s[:-1]]
    if not len(dup):
        return np.zeros(len(keys), bool)
    dup = dup[np.concatenate(([True], dup[1:] != dup[:-1]))]
    at = np.minimum(np.searchsorted(dup, keys), len(dup) - 1)
    return dup[at] == keys

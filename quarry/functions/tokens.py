"""Tokenisation and token windows (F1, F2, UD4).

The default tokenizer is whole-word pieces that carry their leading
whitespace (``\\s*\\S+``), so joining a slice of pieces gives back the exact
source text of that window and a window never splits a character.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_PIECE = r"\s*\S+"
EMBED_TERM = r"[\p{L}\p{N}]+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def word_pieces(x) -> Column:
    """Array of whitespace-led pieces; ``array_join(pieces, '')`` is the text
    without its trailing whitespace."""
    return F.regexp_extract_all(_c(x), F.lit(WORD_PIECE), 0)


def word_run(n: int) -> str:
    """A pattern of as many pieces in a row as there are, at most ``n``. It never
    goes back: a piece cannot end elsewhere, and a run takes no stack."""
    return rf"(?:\s*+\S++){{1,{n}}}+"


def word_runs(x, n: int) -> Column:
    """The text of ``word_pieces`` in runs of ``n`` pieces (the last may have
    fewer)."""
    return F.regexp_extract_all(_c(x), F.lit(word_run(n)), 0)


def window_starts(n_tokens: Column, size: int, overlap: int) -> Column:
    """Window starts 0, step, 2*step ... while start < n (S5); empty for 0
    tokens. The last window may lie wholly inside the one before it."""
    if overlap < 0 or overlap >= size:
        raise ValueError("chunk_overlap must be in [0, chunk_size)")
    step = size - overlap
    return F.when(n_tokens > 0, F.sequence(F.lit(0), n_tokens - 1, F.lit(step))) \
        .otherwise(F.array().cast("array<int>"))


def window_count(n_tokens: Column, size: int, overlap: int) -> Column:
    """``ceil(n / step)`` windows."""
    step = size - overlap
    return F.ceil(n_tokens / F.lit(step)).cast("int")


def embed_terms(x) -> Column:
    """Lower-cased letter/digit runs: the terms of the hashed embedder."""
    return F.regexp_extract_all(F.lower(_c(x)), F.lit(EMBED_TERM), 0)

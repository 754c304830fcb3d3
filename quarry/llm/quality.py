"""Quality rules by repetition coverage.

Method: rolling hashes of several n-gram lengths in numpy. Per document, the
characters (code points) that lie inside duplicated word n-grams and inside
duplicated lines are measured and compared with limits; nothing else decides.
Words with a run of three or more of one symbol glued on are counted beside.

Texts travel to Python as Arrow batches (only the text column does) and come
back as one struct per row, so the operator adds no shuffle. Work goes block
by block (about 1 MB of text), so memory follows the Arrow batch, not the
table; a longer document is a block of its own.

Defined results: null text = empty text (no words, fails the base rule).
Repeated rows get the same verdict each. Empty tables give empty results.
Existing columns named like an output column are replaced; all other columns
pass through unchanged.
"""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import _text as tx

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

#: share of word characters inside duplicated n-grams, by n, above which a
#: document is rejected
NGRAM_LIMITS = {3: 0.50, 5: 0.25, 7: 0.22, 10: 0.20}

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", "n_glued_words"]


@dataclass(frozen=True)
class QualityRules:
    """Production limits. ``ngram_limits`` maps n to the largest share of a
    document's word characters that duplicated n-grams may cover."""
    min_words: int = 10
    base_window: int = 5
    max_repeat_words_pct: int = 20
    max_dup_line_chars: float = 0.20
    ngram_limits: dict = field(default_factory=lambda: dict(NGRAM_LIMITS))


def _covered(pos: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which words lie in a window of n words that starts at one of ``pos``."""
    diff = np.zeros(size + 1, np.int32)
    diff[pos] += 1
    diff[pos + n] -= 1
    return np.cumsum(diff[:-1]) > 0


def measure(buf: np.ndarray, off: np.ndarray, window: int, lengths: list[int]) -> tuple[dict, dict]:
    """Counts per document of one block, and the covered characters per n."""
    n = len(off) - 1
    lines_at = buf == tx.NEWLINE
    chars, prefix = tx.code_points(buf), tx.rolling(buf)
    start, end = tx.spans(buf, ~tx.SEP[buf], off)
    doc = tx.doc_of(off, start)
    length = chars[end] - chars[start]
    salt = tx.mix(np.arange(1, n + 1, dtype=np.uint64))
    total = lambda d, w=None: np.bincount(d, w, minlength=n).astype(np.int64)
    out = {"n_words": total(doc), "word_chars": total(doc, length)}
    sym = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(SYMBOLS[buf], out=sym[1:])
    out["n_symbols"] = sym[off[1:]] - sym[off[:-1]]
    run = np.zeros(len(buf) + 1, np.int64)       # runs of three that begin before each byte
    np.cumsum(SYMBOLS[buf[:-2]] & (buf[:-2] == buf[1:-1]) & (buf[1:-1] == buf[2:]), out=run[1:len(buf) - 1])
    glued = (run[np.maximum(end - 2, start)] > run[start]) & (sym[end] - sym[start] < end - start)
    out["n_glued_words"] = total(doc[glued])

    # lines with a word, compared as whole byte strings
    ls, le = tx.spans(buf, ~lines_at, off)
    has = np.searchsorted(start, ls) < np.searchsorted(start, le)
    ls, le = ls[has], le[has]
    ldoc = tx.doc_of(off, ls)
    key = tx.span_hash(prefix, ls, le) ^ salt[ldoc] if len(ls) else np.zeros(0, np.uint64)
    order = np.argsort(key, kind="stable")
    later = np.zeros(len(key), bool)
    later[order[1:]] = key[order[1:]] == key[order[:-1]]
    out["n_dup_lines"] = total(ldoc[later])
    out["dup_line_chars"] = total(ldoc[later], (chars[le] - chars[ls])[later])

    # an n-gram repeats only where its (n-1)-gram does, so each length looks
    # at what the length before it has left
    words = tx.span_hash(prefix, start, end)
    covered, alive = {}, None
    for k in sorted({window, *lengths}):
        m = len(words) - k + 1
        if m <= 0:
            hit = np.zeros(0, np.int64)
        elif alive is None:
            h = tx.ngram_hash(words, k)
            pos = np.flatnonzero(doc[:m] == doc[k - 1:])
            hit = pos[tx.duplicated(tx.mix(h[pos]) ^ salt[doc[pos]])]
        else:
            pos = alive[alive < m]
            pos = pos[doc[pos] == doc[pos + k - 1]]
            h = words[pos]
            for j in range(1, k):
                h = h * np.uint64(tx.BASE) + words[pos + j]
            hit = pos[tx.duplicated(tx.mix(h) ^ salt[doc[pos]])]
        alive = hit
        cover = _covered(hit, k, len(words)) if len(hit) else np.zeros(len(words), bool)
        if k == window:
            out["n_repeat_words"] = total(doc[cover])
        covered[k] = total(doc[cover], length[cover])
    return out, covered


def quality_rules(df: DataFrame, rules: QualityRules | None = None, text_col: str = "text") -> DataFrame:
    """Adds the counts, ``base_failed`` and ``kept`` to every row.

    ``kept`` is false where the base rule fails (too few words, or too many
    words in repeated windows), or where duplicated lines or duplicated n-grams
    of some length hold too large a share of the characters."""
    rules = rules or QualityRules()
    lengths = sorted(rules.ngram_limits)
    kind = "struct<" + ",".join(f"{c}:bigint" for c in [*COUNTS, *(f"dup_{k}gram_chars" for k in lengths)]) + ">"

    @F.arrow_udf(kind)
    def counts(texts: pa.Array) -> pa.Array:
        parts = []
        for _, buf, off in tx.blocks(texts):
            out, covered = measure(buf, off, rules.base_window, lengths)
            parts.append([out[c] for c in COUNTS] + [covered[k] for k in lengths])
        names = [*COUNTS, *(f"dup_{k}gram_chars" for k in lengths)]
        cols = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64)
                for i in range(len(names))]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    made = [*COUNTS, *(f"dup_{k}gram_chars" for k in lengths), "base_failed", "kept"]
    rest = [c for c in df.columns if c not in made]
    got = df.select(*[F.col(f"`{c}`") for c in rest], counts(F.col(f"`{text_col}`").cast("string")).alias("__q"))
    got = got.select(*[F.col(f"`{c}`") for c in rest], "__q.*")
    base = (F.col("n_words") < rules.min_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_words_pct)
    bad = F.col("dup_line_chars") > F.col("word_chars") * rules.max_dup_line_chars
    for k in lengths:
        bad = bad | (F.col(f"dup_{k}gram_chars") > F.col("word_chars") * rules.ngram_limits[k])
    return got.withColumn("base_failed", base).withColumn("kept", ~(base | bad))

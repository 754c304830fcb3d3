"""Text cleaning and small string helpers, all as Column expressions.

Everything here compiles to JVM expressions (regexp_replace, higher-order
array functions); no Python runs per row.
"""
from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's cleaning rules)
# ---------------------------------------------------------------------------
# blank-line runs: 3 or more newlines -> 2; horizontal runs of space/tab -> 1
BLANK_RUN = r"\n{3,}"
HSPACE_RUN = r"[ \t]+"
# a page-number line (tested case-insensitively on the stripped line)
PAGE_LINE = r"^(Page\s+)?\d+(\s+of\s+\d+)?$"
# a separator line
SEPARATOR_LINE = r"^[-_=]{5,}$"
# typographic characters and their replacements
CHAR_MAP = {
    "\u2019": "'",    # right single quote
    "\u2018": "'",    # left single quote
    "\u201c": '"',    # left double quote
    "\u201d": '"',    # right double quote
    "\u2013": "-",    # en dash
    "\u2014": "--",   # em dash
    "\u2026": "...",  # ellipsis
    "\u00a0": " ",    # no-break space
}
# ---------------------------------------------------------------------------

# Python's str.strip() set: every code point for which str.isspace() holds
# (derived by rule, not listed by hand)
UNICODE_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends
    (``btrim`` touches only the ends, no regex scan of the text)."""
    return F.btrim(_c(x), F.lit(UNICODE_SPACE))


# same result as HSPACE_RUN -> " ", but a lone space (the common case) is
# not matched, so ordinary text is not rewritten character by character
_HSPACE_TO_FIX = r"[ \t]{2,}|\t"


def _where(x, needed, change) -> Column:
    """``change`` of the text where ``needed`` says so, else the text as it is;
    bound once through a single-element ``transform``."""
    return F.element_at(F.transform(F.array(_c(x)), lambda c: F.when(needed(c), change(c)).otherwise(c)), 1)


def normalize_whitespace(x) -> Column:
    """PF1: blank-line runs to one blank line, space/tab runs to one space. A
    text is only matched against a pattern if it holds what the pattern starts
    with."""
    c = _where(x, lambda t: F.contains(t, F.lit("\n\n\n")), lambda t: F.regexp_replace(t, BLANK_RUN, "\n\n"))
    return _where(c, lambda t: F.contains(t, F.lit("  ")) | F.contains(t, F.lit("\t")),
                  lambda t: F.regexp_replace(t, _HSPACE_TO_FIX, " "))


def is_header_footer(line: Column) -> Column:
    """True for page-number lines and separator lines (tested stripped)."""
    s = strip(line)
    return s.rlike("(?iU)" + PAGE_LINE) | s.rlike("(?U)" + SEPARATOR_LINE)


def remove_headers_footers(x) -> Column:
    """PF2: drop page-number / separator lines; keep the others unstripped.

    ``split`` with limit -1 keeps empty lines, like Python ``str.split``."""
    lines = F.split(_c(x), "\n", -1)
    kept = F.filter(lines, lambda l: ~is_header_footer(l))
    return F.array_join(kept, "\n")


def fix_encoding_artifacts(x) -> Column:
    """PF3: typographic characters to ASCII. One-to-one pairs go through a
    single ``translate``; the two one-to-many pairs through ``replace``. Texts
    without any of them, ASCII ones first, are left alone."""
    one_to_one = {k: v for k, v in CHAR_MAP.items() if len(v) == 1}

    def needed(t):
        return (F.octet_length(t) > F.char_length(t)) & reduce(or_, (F.contains(t, F.lit(k)) for k in CHAR_MAP))

    def fix(t):
        c = F.translate(t, "".join(one_to_one), "".join(one_to_one.values()))
        for k, v in CHAR_MAP.items():
            if len(v) > 1:
                c = F.replace(c, F.lit(k), F.lit(v))
        return c

    return _where(x, needed, fix)


def clean_text(x) -> Column:
    """PF4: whitespace -> header/footer lines -> characters -> strip.

    The order matters (cleaning is not idempotent): NBSP becomes a space
    only after space runs were collapsed, and dropped lines may leave new
    blank runs."""
    return strip(fix_encoding_artifacts(remove_headers_footers(
        normalize_whitespace(_c(x)))))


def word_count(x) -> Column:
    """``len(s.split())``: runs of non-whitespace (Unicode)."""
    return F.regexp_count(_c(x), F.lit(r"(?U)\S+")).cast("int")


def split_sentences(x) -> Column:
    """split after . ! ? followed by whitespace; keep stripped pieces
    longer than 10 characters."""
    parts = F.split(strip(_c(x)), r"(?U)(?<=[.!?])\s+", -1)
    return F.filter(F.transform(parts, lambda s: strip(s)),
                    lambda s: F.length(s) > 10)


def preview(x, n: int = 150) -> Column:
    """PF8: first ``n`` characters and an ellipsis, always."""
    return F.concat(F.substring(_c(x), 1, n), F.lit("..."))


def ellipsize(x, n: int = 100) -> Column:
    """first ``n`` characters plus an ellipsis only when longer."""
    c = _c(x)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))) \
        .otherwise(c)


def truncate(x, n: int = 200) -> Column:
    """PF11: first ``n`` characters (report projection)."""
    return F.substring(_c(x), 1, n)

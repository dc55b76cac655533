"""Text expressions (D1, D2, D6, D8, S8 helpers), all built-in Spark functions.

Whitespace is Python's set (``str.isspace``), spelled out for Java regexes and
for Spark's character-set ``trim``, so ``split()`` / ``strip()`` agree exactly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.columns import col

# Python's whitespace (``str.isspace``), used by ``split()`` and
# ``strip()``.  Java's ``\s`` (even with ``(?U)``) is a different set.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WS_CLASS = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WS_RUN = WS_CLASS + "+"
# Sentence boundary: after . ! ? followed by whitespace, or at newline runs.
SENTENCE_BOUNDARY = r"(?<=[.!?])" + WS_RUN + r"|\n+"
CASED = r"[\p{Lu}\p{Ll}\p{Lt}]"


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing whitespace (a plain
    character-set trim, no regex)."""
    return F.trim(col(c), F.lit(PY_WHITESPACE))


def words(c) -> Column:
    """Whitespace tokens, no empty tokens (Python ``str.split()``)."""
    return F.filter(F.split(col(c), WS_RUN), lambda w: w != "")


def word_windows(word_array, size: int = 500, overlap: int = 50) -> Column:
    """Overlapping windows of ``size`` words starting every size-overlap
    words while start < n; words re-joined by one space.  n = 0 gives [].

    When step < n <= size there are two windows and the second lies inside the
    first -- the reference's behaviour, kept on purpose.
    """
    if size <= overlap:
        raise ValueError("chunk_size must be greater than overlap")
    w = col(word_array)
    n = F.size(w)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size - overlap))).otherwise(
        F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.array_join(F.slice(w, s + 1, F.lit(size)), " "))


def sentences(c) -> Column:
    """Split after . ! ? + whitespace or at newline runs; strip; drop empties."""
    parts = F.split(strip_ws(c), SENTENCE_BOUNDARY)
    return F.filter(F.transform(parts, strip_ws), lambda s: s != "")


def casefold(c) -> Column:
    """Caseless key.  Python ``casefold`` also maps German sharp s to 'ss',
    which ``lower`` does not."""
    return F.replace(F.lower(col(c)), F.lit("ß"), F.lit("ss"))


def preview(c, n: int = 300) -> Column:
    """Collapse whitespace, first ``n`` characters, then '...'."""
    return F.concat(F.substring(strip_ws(F.regexp_replace(col(c), WS_RUN, " ")), 1, n), F.lit("..."))


def title_chars(filename) -> Column:
    """S8 step 1: strip '.txt', '_' -> ' ', split into characters."""
    base = F.replace(F.replace(col(filename), F.lit(".txt"), F.lit("")), F.lit("_"), F.lit(" "))
    return F.split(base, "")


def python_title_chars(chars) -> Column:
    """Python ``str.title()`` over a character array: a cased letter is
    upper-cased when the previous character is not a cased letter, else
    lower-cased (so 'x2y' -> 'X2Y', unlike Spark's ``initcap``).  Pass a
    column reference: the array is indexed inside the lambda."""
    ch_arr = col(chars)
    return F.array_join(
        F.transform(
            ch_arr,
            lambda ch, i: F.when((i == 0) | ~F.element_at(ch_arr, i).rlike(CASED), F.upper(ch))
            .otherwise(F.lower(ch)),
        ),
        "",
    )

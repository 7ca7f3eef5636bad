"""Text expressions: null tokens, blank test, tokenizer, stopwords.

All of these are Catalyst expressions (no Python per row).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------------
# Cell texts that pandas' CSV reader turns into a missing value by default.
NA_TOKENS = (
    "", "NA", "N/A", "n/a", "#N/A", "#N/A N/A", "#NA", "<NA>", "NULL", "null", "None",
    "NaN", "nan", "-NaN", "-nan", "1.#IND", "-1.#IND", "1.#QNAN", "-1.#QNAN",
)

# Stopwords dropped before keyword counting (34 words, same list in both keyword scripts).
STOPWORDS = (
    "그리고", "그러나", "하지만", "또한", "있다", "없다", "이다", "이", "가", "은", "는", "을", "를",
    "에", "의", "도", "로", "과", "와", "한", "하다", "것", "수", "들", "좀", "잘", "너무", "더", "만",
    "까지", "처럼", "에서", "부터", "되다",
)
# ------------------------------------------------------------------------------------------

# Default tokenizer pattern: maximal runs of Unicode letters. Java regex and RE2 agree on it.
WORD_PATTERN = r"\p{L}+"


def null_if_na(col: Column | str, tokens: Iterable[str] = NA_TOKENS) -> Column:
    """Map the pandas missing-value tokens to null (string columns only)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isin(list(tokens)), F.lit(None).cast("string")).otherwise(c)


def has_text(col: Column | str) -> Column:
    """True when the text holds a non-whitespace character (Python ``str.strip()`` rule).

    ``trim`` only strips U+0020; ``(?U)\\S`` treats tab, newline and U+3000 as space too.
    Null stays null, so ``filter`` drops it.
    """
    c = F.col(col) if isinstance(col, str) else col
    return c.rlike(r"(?U)\S")


def regex_tokens(col: Column | str, pattern: str = WORD_PATTERN) -> Column:
    """array<string> of all regex matches; the default tokenizer."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract_all(c, F.lit(pattern), 0)


def keep_token(word: Column, stopwords: Iterable[str] = STOPWORDS, min_len: int = 2) -> Column:
    """Predicate on ONE exploded token: long enough and not a stopword (codegen'd; the
    stopword test is a hash ``InSet``)."""
    stop = list(stopwords)
    cond = F.length(word) >= min_len
    return cond & ~word.isin(stop) if stop else cond


def keep_tokens(tokens: Column, stopwords: Iterable[str] = STOPWORDS, min_len: int = 2) -> Column:
    """Array form of :func:`keep_token` (a lambda ``filter``; used for per-row token lists --
    bulk counting explodes first and filters with :func:`keep_token` instead)."""
    stop = [s for s in stopwords]
    if stop:
        stop_arr = F.array(*[F.lit(s) for s in stop])
        return F.filter(tokens, lambda t: (F.length(t) >= min_len) & ~F.array_contains(stop_arr, t))
    return F.filter(tokens, lambda t: F.length(t) >= min_len)


Tokenizer = Callable[[Column], Column]

"""J18 keywords: top-N tokens per group and token totals.

Texts are never concatenated per group (one huge string per group cannot scale, D11):
each row is tokenized where it lies, tokens are exploded, and ``(group, word)`` counts are
partially aggregated before the shuffle, so a hot group ships one counter per distinct word
per task. The top-N is a ``row_number`` window filtered to ``<= n`` which Spark plans as a
``WindowGroupLimit`` (a per-task top-N before the shuffle and again after it).

Ties are broken by the word, ascending (the reference's first-appearance order is not
reproducible on a cluster, SURVEY T19).

The tokenizer is pluggable: any ``Column -> array<string>`` function. The default is the
Catalyst regex tokenizer; a ``pandas_udf`` returning ``array<string>`` (e.g. a morphological
analyser) can be passed instead and runs Arrow-batched in the Python workers. ``pandas_tokenizer``
makes one that is handed bounded slices of the batches: the tokens of a batch take a multiple of its
texts, in Python far more than in Arrow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressroom.functions.text import STOPWORDS, Tokenizer, keep_token, keep_tokens, regex_tokens


# Characters of the texts whose tokens a Python worker holds at once (one longer text stands alone).
SLICE_CHARS = 1 << 19


def pandas_tokenizer(split: Callable[[pd.Series], pd.Series], slice_chars: int = SLICE_CHARS) -> Tokenizer:
    """A tokenizer of a function from texts to their token lists, called on slices of about
    ``slice_chars`` characters: a worker holds the tokens of one slice, whatever the texts and batches."""
    def tokens_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            sizes = texts.str.len().fillna(0).to_numpy(dtype="int64")
            slices = (np.cumsum(sizes) - sizes) // slice_chars  # by where a text begins
            cuts = np.flatnonzero(np.diff(slices)) + 1
            for at, end in zip([0, *cuts], [*cuts, len(texts)], strict=True):
                yield split(texts.iloc[at:end])

    return F.pandas_udf(tokens_of, "array<string>")


def tokenize(df: DataFrame, text: str = "comments", tokenizer: Tokenizer | None = None,
             stopwords: Iterable[str] = STOPWORDS, min_len: int = 2, out: str = "tokens") -> DataFrame:
    """Adds ``out``: the kept tokens of ``text`` as an array (null text -> empty array)."""
    tok = (tokenizer or regex_tokens)(F.coalesce(F.col(text), F.lit("")))
    return df.withColumn(out, keep_tokens(tok, stopwords, min_len))


def _exploded(df: DataFrame, by: list[str], text: str, tokenizer: Tokenizer | None) -> DataFrame:
    """One row per raw token (``posexplode_outer``: a row without tokens stays, word null)."""
    tok = (tokenizer or regex_tokens)(F.coalesce(F.col(text), F.lit("")))
    return df.select(*by, F.posexplode_outer(tok).alias("pos", "word"))


def token_counts(df: DataFrame, by: str | list[str], text: str = "comments", tokenizer: Tokenizer | None = None,
                 stopwords: Iterable[str] = STOPWORDS, min_len: int = 2) -> DataFrame:
    by = [by] if isinstance(by, str) else list(by)
    words = _exploded(df, by, text, tokenizer).filter(keep_token(F.col("word"), stopwords, min_len))
    return words.groupBy(*by, "word").agg(F.count(F.lit(1)).alias("n"))


def top_tokens(df: DataFrame, by: str | list[str], n: int = 20, text: str = "comments", **kw) -> DataFrame:
    """The ``n`` most frequent kept tokens per group with their rank."""
    by = [by] if isinstance(by, str) else list(by)
    counts = token_counts(df, by, text, **kw)
    w = Window.partitionBy(*by).orderBy(F.desc("n"), F.asc("word"))
    return (counts.withColumn("rank", F.row_number().over(w))
                  .filter(F.col("rank") <= n)
                  .select(*by, "rank", "word", "n"))


def token_totals(df: DataFrame, by: str | list[str], text: str = "comments", tokenizer: Tokenizer | None = None,
                 stopwords: Iterable[str] = STOPWORDS, min_len: int = 2) -> DataFrame:
    """Per group the number of kept tokens (what the reference prints as its
    'comment count') next to the real number of comments. One pass: every comment yields
    exactly one row with ``pos`` 0 or null."""
    by = [by] if isinstance(by, str) else list(by)
    rows = _exploded(df, by, text, tokenizer)
    kept = F.col("word").isNotNull() & keep_token(F.col("word"), stopwords, min_len)
    return rows.groupBy(*by).agg(F.count_if(kept).alias("n_tokens"),
                                 F.count_if(F.col("pos").isNull() | (F.col("pos") == 0)).alias("n_comments"))

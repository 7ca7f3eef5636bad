"""J17 mean emotion scores per press x file / day / month / month-to-date, J22 top emotions
(C7, D8, D9, E3, F5, F6, U2, T3, T4).

Every comment is scored exactly once (the reference re-scores all earlier files of the month
for each new file -- quadratic in files, SURVEY 4). Scores become per-file ``(sum, count)``
partial aggregates; the month-to-date mean is then a running sum over the FILES of a
press x month (``rowsBetween(unboundedPreceding, currentRow)``), so the window sees one row
per file, not one per comment.

Scorers are pluggable:

* ``LexiconScorer`` (default) -- per label, the share of a comment's tokens found in the
  label's word list; pure Catalyst, runs in whole-stage codegen.
* ``pandas_scorer(fn, labels)`` -- wraps a batch function ``list[str] -> 2-D scores`` (e.g. a
  text-classification model) as an Arrow-batched ``pandas_udf`` returning
  ``array<double>`` in label order. The model is loaded once per Python worker by ``fn``.
  Scores must be pure per row so results do not depend on batch size.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressroom.functions.text import WORD_PATTERN, has_text
from pressroom.operators.running import running_sums


class LexiconScorer:
    """Label score = (# tokens of the comment in the label's lexicon) / (# tokens).
    Lower-cased ``\\p{L}+`` tokens; a comment with no letter scores 0 on every label.

    Counting is two ``regexp_count`` calls per label -- whole tokens are matched with
    letter look-arounds -- so the scorer stays inside whole-stage codegen (no lambdas, no
    per-row arrays of tokens)."""

    def __init__(self, lexicon: Mapping[str, Sequence[str]], pattern: str = WORD_PATTERN):
        self.labels = list(lexicon)
        self.lexicon = {k: [w.lower() for w in v] for k, v in lexicon.items()}
        self.pattern = pattern
        self.word_patterns = {
            k: r"(?<!\p{L})(?:" + "|".join(re.escape(w) for w in sorted(set(v), key=lambda w: (-len(w), w)))
               + r")(?!\p{L})"
            for k, v in self.lexicon.items()}

    def __call__(self, text: Column) -> Column:
        """Single-expression form (array of label scores), for ad-hoc use."""
        low = F.lower(text)
        n = F.regexp_count(low, F.lit(self.pattern))
        return F.array(*[F.when(n > 0, F.regexp_count(low, F.lit(self.word_patterns[lab])) / n).otherwise(F.lit(0.0))
                         for lab in self.labels])

    def apply(self, df: DataFrame, text: str, valid: Column, prefix: str = "_sc") -> DataFrame:
        """Adds ``{prefix}{i}`` per label for rows where ``valid``. Staged projections: the
        lower-cased text and the token count are computed once per row and referenced
        by every label (Catalyst does not collapse projections that would duplicate them)."""
        staged = df.withColumn("_low", F.when(valid, F.lower(F.col(text))))
        staged = staged.withColumn("_n", F.regexp_count(F.col("_low"), F.lit(self.pattern)))
        staged = staged.withColumns({f"_h{i}": F.regexp_count(F.col("_low"), F.lit(self.word_patterns[lab]))
                                     for i, lab in enumerate(self.labels)})
        staged = staged.withColumns({f"{prefix}{i}": F.when(F.col("_n") > 0, F.col(f"_h{i}") / F.col("_n"))
                                                      .when(valid, F.lit(0.0))
                                     for i in range(len(self.labels))})
        return staged.drop("_low", "_n", *[f"_h{i}" for i in range(len(self.labels))])


def label_scores(rows, labels: Sequence[str]) -> list[list[float]]:
    """A model's rows to scores in the order of ``labels``. A row is a mapping or a sequence of
    (label, score) pairs or of ``{"label": .., "score": ..}`` -- taken by name, a missing label is
    0.0, an unknown one is skipped, of a repeated one the last counts -- or a sequence of plain
    numbers, which must be one per label."""
    out = []
    for row in rows:
        items = list(row.items()) if isinstance(row, Mapping) else list(row)
        if items and isinstance(items[0], Mapping):
            items = [(x["label"], x["score"]) for x in items]
        if items and isinstance(items[0], (tuple, list)):
            named = dict(items)
            out.append([float(named.get(lab, 0.0)) for lab in labels])
        elif isinstance(row, Mapping) or not items and labels:
            out.append([0.0] * len(labels))
        elif len(items) == len(labels):
            out.append([float(x) for x in items])
        else:
            raise ValueError(f"a score row has {len(items)} numbers for {len(labels)} labels")
    return out


def pandas_scorer(load: Callable, labels: Sequence[str], loads: bool = False):
    """Wrap a batch scoring function as an Arrow-batched pandas UDF (the U2 plug-in point).

    The function gets a list of comment texts and returns one row per text, see
    :func:`label_scores`. With ``loads``, ``load()`` returns that function and is called once per
    partition, so a model is loaded there and not per batch; else ``load`` is the function. Blank
    and null texts are never sent to it."""
    labels = list(labels)
    k = len(labels)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def _score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fn = load() if loads else load
        for texts in batches:
            sent = texts.notna()
            rows = label_scores(fn(texts[sent].tolist()), labels) if sent.any() else []
            if len(rows) != int(sent.sum()):
                raise ValueError("the scorer must return one row per text")
            out = pd.Series([None] * len(texts), dtype=object)
            for at, row in zip(sent.to_numpy().nonzero()[0], rows, strict=True):
                out.iat[int(at)] = row
            yield out

    class _Scorer:
        def __init__(self):
            self.labels = labels

        def __call__(self, text: Column) -> Column:
            return _score(F.when(has_text(text), text))

        def apply(self, df: DataFrame, text: str, valid: Column, prefix: str = "_sc") -> DataFrame:
            out = df.withColumn("_arr", _score(F.when(valid, F.col(text))))
            return out.withColumns({f"{prefix}{i}": F.col("_arr")[i] for i in range(k)}).drop("_arr")

    return _Scorer()


def _apply_scorer(scorer, df: DataFrame, text: str, valid: Column, prefix: str = "_sc") -> DataFrame:
    """Use the scorer's staged ``apply`` when it has one, else its array expression."""
    if hasattr(scorer, "apply"):
        return scorer.apply(df, text, valid, prefix)
    out = df.withColumn("_arr", F.when(valid, scorer(F.col(text))))
    return out.withColumns({f"{prefix}{i}": F.col("_arr")[i] for i in range(len(scorer.labels))}).drop("_arr")


SCOPES = ("month_to_date", "file", "day", "month")


def comment_scores(df: DataFrame, scorer, text: str = "comments", keys: Sequence[str] = ()) -> DataFrame:
    """One row per non-blank comment: ``keys`` + ``scores`` (array<double>, label order)."""
    return (df.select(*keys, text).filter(has_text(text))
              .select(*keys, scorer(F.col(text)).alias("scores")))


def mean_scores(df: DataFrame, scorer, press: str = "press_name", month: str = "month",
                file: str = "file_name", order: str | None = None, day: str | None = None,
                text: str = "comments", scope: str = "month_to_date", places: int | None = 6) -> DataFrame:
    """Mean label scores per press x month x file (or day / month), see module doc.

    * ``month_to_date`` (reference default, T3): for each file, the mean over all non-blank
      comments of this press and month in files up to and including it, files ordered by
      ``order`` (default: the file name). A file without comments still gets a row (T4):
      null when nothing came before it. A hot press-month is spread over several tasks
      (``operators.running``).
    * ``file``: mean over the file's own comments; ``day``: per ``day`` column;
      ``month``: one row per press x month.
    """
    if scope not in SCOPES:
        raise ValueError(scope)
    labels = scorer.labels
    order = order or file
    file_keys = [press, month, file] + ([order] if order != file else []) + ([day] if day else [])
    rows = df.select(*file_keys, text).filter(F.col(press).isNotNull())
    rows = rows.withColumn("ok", F.coalesce(has_text(text), F.lit(False)))
    scored = _apply_scorer(scorer, rows, text, F.col("ok"))
    sums = [F.sum(f"_sc{i}").alias(f"s{i}") for i in range(len(labels))]

    if scope == "month":
        grouped = scored.groupBy(press, month).agg(F.count_if("ok").alias("n_comments"), *sums)
        keys = [press, month]
    elif scope == "day":
        if not day:
            raise ValueError("scope='day' needs a day column")
        grouped = scored.groupBy(press, month, day).agg(F.count_if("ok").alias("n_comments"), *sums)
        keys = [press, month, day]
    else:
        per_file = scored.groupBy(*file_keys).agg(F.count_if("ok").alias("n_comments"), *sums)
        keys = file_keys
        if scope == "month_to_date":
            sums_ = {"n_comments": F.col("n_comments"), **{f"s{i}": F.col(f"s{i}") for i in range(len(labels))}}
            grouped = running_sums(per_file.withColumnsRenamed({c: f"_{c}" for c in sums_}),
                                   {c: F.col(f"_{c}") for c in sums_}, [order, file], keys=[press, month])
        else:
            grouped = per_file

    def mean(i):
        m = F.try_divide(F.col(f"s{i}"), F.col("n_comments").cast("double"))
        return F.round(m, places) if places is not None else m

    return grouped.select(*keys, "n_comments", *[mean(i).alias(lab) for i, lab in enumerate(labels)])


def top_emotions(scores: DataFrame, labels: Sequence[str], keys: Sequence[str], k: int = 5) -> DataFrame:
    """The ``k`` highest labels per key (ties by label name), long form."""
    long = scores.unpivot(list(keys), list(labels), "emotion", "score").filter(F.col("score").isNotNull())
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("emotion"))
    return (long.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
                .select(*keys, "rank", "emotion", "score"))


def score_table(scores_df: DataFrame, labels: Sequence[str], press: str = "press_name", month: str = "month",
                file: str = "file_name") -> DataFrame:
    """The per-press score table -- ``press_name``, ``year-month-day`` (the
    month plus the day cut from the file name: its third piece split on ``-`` or ``_``), then
    one mean per label in label order. Write it with ``sink.write_table(...,
    partition_by=["press_name"])`` for one folder per press."""
    day = F.get(F.split(F.col(file), "[-_]"), 2)
    return scores_df.select(F.col(press).alias("press_name"),
                            F.concat_ws("-", F.col(month), day).alias("year-month-day"),
                            *[F.col(f"`{lab}`") for lab in labels])

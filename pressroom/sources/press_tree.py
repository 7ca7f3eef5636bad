"""J1 ingest of a press tree ``<root>/<press>/<YYYY-MM-DD>_<press>_<title>.csv``
(A1-A5, B7, B19-B21, D14, G1, T13-T16, T24, T25).

Why not ``spark.read.csv(root)``: (a) Spark binds headers by position across files, so files
whose columns come in another order mix silently (T15); (b) CP949 / EUC-KR need a global
legacy flag and bad UTF-8 decodes to U+FFFD without error (T16); (c) only the empty field
becomes null (T13).

Plan:

1. ``root/*/*.csv`` is scanned in ranges by ``sources.split_csv`` (month pruning by glob: files of
   other months are never opened, A5): small files share a task, a large one is dealt over many.
2. Each file is decoded strictly with the first encoding that works for all of it; quoted fields may
   hold newlines (T14) and cross ranges. Binding is **by header name**. Files that fail are reject
   rows, never garbage.
3. Catalyst does the rest: press from the folder, date from the file name (first ISO date;
   none -> reject, T24), null tokens -> null, ``try_cast`` to the declared types, columns in
   output order (B20), extra columns appended with nulls where absent (G1).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom.functions.text import NA_TOKENS, null_if_na
from pressroom.sources.split_csv import CsvFiles

# --- fixed values -------------------------------------------------------------------------
# Encodings tried in order; the first that decodes the whole file wins.
ENCODINGS = ("utf-8", "cp949", "euc-kr")
# Article-comment columns in file order with their types.
COMMENT_COLUMNS = (
    ("user_nickname", "string"),
    ("userIdNo", "string"),
    ("comments", "string"),
    ("visible", "boolean"),
    ("replyLevel", "bigint"),
    ("regTime", "string"),
    ("parentCommentNo", "string"),
    ("sympathyCount", "bigint"),
    ("antipathyCount", "bigint"),
    ("replyAllCount", "bigint"),
)
DATE_IN_NAME = r"\d{4}-\d{2}-\d{2}"
# ------------------------------------------------------------------------------------------

LAYOUTS = ("press", "partitioned")


def _file_paths(root: str, months: Iterable[str] | None, layout: str) -> list[str]:
    """``press``: ``root/<press>/<date>_<press>_<title>.csv`` (month pruning on the name);
    ``partitioned``: the J2 sink layout ``root/press_name=<press>/date=<date>/*.csv``
    (month pruning on the date folder)."""
    root = root.rstrip("/")
    if layout == "press":
        return [f"{root}/*/*.csv"] if not months else [f"{root}/*/{m}*.csv" for m in months]
    if layout == "partitioned":
        return ([f"{root}/press_name=*/date=*/*.csv"] if not months
                else [f"{root}/press_name=*/date={m}*/*.csv" for m in months])
    raise ValueError(f"layout must be one of {LAYOUTS}")


def _unescape_partition(value):
    """Partition folder values are %XX-escaped by Spark's writer ('+' is left as is)."""
    return F.when(value != "__HIVE_DEFAULT_PARTITION__", F.try_url_decode(F.regexp_replace(value, r"\+", "%2B")))


def _path_parts(path_col, layout: str):
    """(press, file name, date) from the listed path (listed paths are not escaped; only the
    partition folders written by Spark are)."""
    parts = F.split(path_col, "/")
    name = F.element_at(parts, -1)
    if layout == "partitioned":
        press = _unescape_partition(F.regexp_replace(F.element_at(parts, -3), r"^press_name=", ""))
        date = F.regexp_extract(F.element_at(parts, -2), "^date=(" + DATE_IN_NAME + ")", 1)
    else:
        press = F.element_at(parts, -2)
        date = F.regexp_extract(name, DATE_IN_NAME, 0)
    return press, name, date


def ingest_press_tree(spark: SparkSession, root: str, months: Iterable[str] | None = None,
                      encodings: Sequence[str] = ENCODINGS, na_tokens: Iterable[str] = NA_TOKENS,
                      columns: Sequence[tuple[str, str]] = COMMENT_COLUMNS,
                      extra_columns: bool | str = "map", with_title: bool = False,
                      layout: str = "press") -> tuple[DataFrame, DataFrame]:
    """Returns ``(comments, rejects)``.

    ``comments``: ``press_name, date`` (+ ``title``) + the declared columns, then the other
    header names found: ``extra_columns="map"`` keeps them in one ``extra`` map column in a single
    pass, ``True`` makes each a top-level string column (union by name, as the reference does), ``False`` drops them.
    ``rejects``: ``path, reason`` for files that could not be decoded or parsed and rows of
    files without a date in their name.
    """
    files = CsvFiles(spark, _file_paths(root, months, layout), encodings)
    declared = [c for c, _ in columns]
    dated = _path_parts(F.col("path"), layout)[2] != ""
    extras = sorted(set(files.names(dated)) - set(declared)) if extra_columns is True else []
    read = files.records([*declared, *extras], rest="extra" if extra_columns == "map" else None)
    press, name, date = _path_parts(F.col("path"), layout)
    rejects = files.rejects().unionByName(files.files.filter(F.col("reason").isNull() & ~dated & (F.col("n_records") > 1)).select(
        "path", F.lit("no date in file name").alias("reason")))
    tokens = list(na_tokens)
    typed = [null_if_na(F.col(f"`{c}`"), tokens).try_cast(t).alias(c) for c, t in columns]
    typed += [null_if_na(F.col(f"`{c}`"), tokens).alias(c) for c in extras]
    if extra_columns == "map":
        typed.append(F.col("extra"))
    lead = [press.alias("press_name"), date.alias("date")]
    if with_title:
        lead.append(F.regexp_extract(name, r"^\d{4}-\d{2}-\d{2}_[^_]*_(.*)\.csv$", 1).alias("title"))
    comments = read.filter(dated).select(*lead, name.alias("file_name"), (F.col("record") - 1).alias("row_no"), *typed)
    return comments, rejects


def files_per_press(comments: DataFrame) -> DataFrame:
    """Number of distinct files per press folder."""
    return comments.groupBy("press_name").agg(F.countDistinct("file_name").alias("n_files"))


def day_of_file(name_col) -> F.Column:
    """Third piece of the file name split on ``-`` or ``_`` (the day of month)."""
    return F.get(F.split(name_col, "[-_]"), 2)


def read_csv_table(spark: SparkSession, path: str, encodings: Sequence[str] = ("cp949", "euc-kr"),
                   na_tokens: Iterable[str] = NA_TOKENS, strict: bool = True) -> DataFrame:
    """A3: one CSV file (or a glob of files with the same meaning) read with an encoding
    fallback, columns bound by header name, all as strings with null tokens -> null (cast
    downstream, e.g. ``try_cast`` in J20). ``strict`` raises when a file cannot be decoded
    or parsed, as the reference aborts; otherwise such files are skipped."""
    files = CsvFiles(spark, path, encodings)
    if strict:
        bad = files.rejects().limit(1).collect()
        if bad:
            raise ValueError(f"cannot read {bad[0].path}: {bad[0].reason} (tried {list(encodings)})")
    tokens = list(na_tokens)
    names = files.names()
    return files.records(names).select(*[null_if_na(F.col(f"`{c}`"), tokens).alias(c) for c in names])

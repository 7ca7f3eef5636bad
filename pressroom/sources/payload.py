"""J3 comment payload pages -> comment rows, with a per-article completeness check
(A6, A14, H4).

A landed payload row is ``(article key, page number, raw text)`` where the text is the
JSONP body ``_callback({"result": {"commentList": [ {...}, ... ]}});``. Parsing is
``regexp_replace`` + ``from_json`` + ``explode``: all Catalyst, row-local, no shuffle.
Pages are grouped by the article key carried in the row, so a page never leaks into the
next article (SURVEY T22). Completeness is a grouped aggregate per article.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------------------
# JSONP wrapper of the comment API and the ten comment fields kept, with their types.
CALLBACK = "_callback("
COMMENT_FIELDS = (
    ("userName", "string"),
    ("contents", "string"),
    ("userIdNo", "string"),
    ("visible", "boolean"),
    ("replyLevel", "bigint"),
    ("regTime", "string"),
    ("parentCommentNo", "string"),
    ("sympathyCount", "bigint"),
    ("antipathyCount", "bigint"),
    ("replyAllCount", "bigint"),
)
# Output names of the article-comment table, in file order (userName -> user_nickname,
# contents -> comments).
OUTPUT_NAMES = {
    "userName": "user_nickname", "userIdNo": "userIdNo", "contents": "comments", "visible": "visible",
    "replyLevel": "replyLevel", "regTime": "regTime", "parentCommentNo": "parentCommentNo",
    "sympathyCount": "sympathyCount", "antipathyCount": "antipathyCount", "replyAllCount": "replyAllCount",
}
PAGE_SIZE = 100
# ------------------------------------------------------------------------------------------

PAYLOAD_SCHEMA = ("struct<result: struct<commentList: array<struct<"
                  + ", ".join(f"{n}: {t}" for n, t in COMMENT_FIELDS) + ">>>>")


def strip_jsonp(text: Column) -> Column:
    """Drop a leading byte-order mark, the ``_callback(`` prefix and the trailing ``);``."""
    body = F.regexp_replace(text, "^\ufeff?\\s*" + CALLBACK.replace("(", "\\("), "")
    return F.regexp_replace(body, r"\);?\s*$", "")


def _parsed(text: Column) -> Column:
    return F.from_json(strip_jsonp(text), PAYLOAD_SCHEMA)


def _readable(text: Column) -> Column:
    """Whether the body is JSON with a ``result`` (``try_parse_json`` is null for what is not JSON)."""
    return F.coalesce(F.is_variant_null(F.try_parse_json(strip_jsonp(text))) == F.lit(False), F.lit(False)) & _parsed(text)["result"].isNotNull()


def one_landing(df: DataFrame, text: str = "payload", article: str = "object_id", page: str = "page") -> DataFrame:
    """One text per (article, page): of several landings a readable one, the longest, then the
    first by text. Grouped ``max_by``, so copies leave a task as one row."""
    rank = F.struct(_readable(F.col(text)).alias("r"), F.length(text).alias("n"), F.col(text).alias("t"))
    return df.groupBy(article, page).agg(F.max_by(F.col(text), rank).alias(text))


def payload_rejects(df: DataFrame, text: str = "payload", article: str = "object_id", page: str = "page") -> DataFrame:
    """Landed pages that cannot be read (null, no JSON, no ``result``): article, page, n_bytes."""
    bad = df.filter(~_readable(F.col(text)))
    return bad.select(article, page, F.coalesce(F.octet_length(text), F.lit(0)).alias("n_bytes"))


def explode_payload(df: DataFrame, text: str = "payload", article: str = "object_id",
                    page: str = "page", rename: bool = True) -> DataFrame:
    """One row per comment: ``article, page, pos`` + the ten fields. A page that landed several
    times counts once (:func:`one_landing`). A page without ``commentList`` yields no rows; the
    unparsable ones are what :func:`payload_rejects` returns."""
    parsed = one_landing(df, text, article, page).select(article, page, _parsed(F.col(text)).alias("p"))
    lst = F.coalesce(F.col("p.result.commentList"), F.array())
    rows = parsed.select(article, page, F.posexplode(lst).alias("pos", "c"))
    names = [(n, OUTPUT_NAMES[n] if rename else n) for n, _ in COMMENT_FIELDS]
    return rows.select(article, page, "pos", *[F.col(f"c.{n}").alias(out) for n, out in names])


def page_report(df: DataFrame, text: str = "payload", article: str = "object_id", page: str = "page",
                page_size: int = PAGE_SIZE) -> DataFrame:
    """Per article -- pages, rows, and ``complete`` = pages are 1..n without gaps, every
    page but the last is full (repeated landings of a page count once), the last has fewer than ``page_size`` rows (an empty last
    page after full ones is fine), and the first page is not empty."""
    sizes = one_landing(df, text, article, page).select(article, page, F.size(F.coalesce(
        _parsed(F.col(text)).getField("result").getField("commentList"), F.array())).alias("n"))
    rep = sizes.groupBy(article).agg(
        F.count(F.lit(1)).alias("n_pages"), F.min(page).alias("first_page"), F.max(page).alias("last_page"),
        F.sum("n").alias("n_rows"),
        F.max_by("n", page).alias("last_rows"),
        F.count_if((F.col("n") < page_size)).alias("n_short"),
        F.min_by("n", page).alias("first_rows"),
    )
    contiguous = (F.col("first_page") == 1) & (F.col("last_page") == F.col("n_pages"))
    complete = (contiguous & (F.col("first_rows") > 0) & (F.col("last_rows") < page_size)
                & (F.col("n_short") == 1))
    return rep.select(article, "n_pages", "n_rows", complete.alias("complete"))


def build_payload(df: DataFrame, article: str, seq: str, fields: Mapping[str, Column | str],
                  page_size: int = PAGE_SIZE) -> DataFrame:
    """Inverse of :func:`explode_payload` (to land payloads from a table): ``seq`` is the
    0-based position of a comment in its article; page = ``seq div page_size + 1``. Each page
    gathers at most ``page_size`` rows, so no group is unbounded and no window is needed."""
    cols = {k: (F.col(v) if isinstance(v, str) else v) for k, v in fields.items()}
    paged = df.select(article, F.col(seq).alias("_seq"), *[c.alias(k) for k, c in cols.items()])
    paged = paged.withColumn("page", F.floor(F.col("_seq") / F.lit(page_size)).cast("long") + 1)
    items = F.array_sort(F.collect_list(F.struct(F.col("_seq"), F.struct(*[F.col(k) for k in cols]).alias("c"))))
    pages = paged.groupBy(article, "page").agg(items.alias("items"))
    body = F.to_json(F.struct(F.struct(F.transform("items", lambda x: x["c"]).alias("commentList")).alias("result")))
    return pages.select(article, "page", F.concat(F.lit(CALLBACK), body, F.lit(");")).alias("payload"))


def json_field(col: str, schema: str) -> Column:
    """Parse a JSON text column with an explicit schema (``from_json``)."""
    return F.from_json(F.col(col), schema)

"""Registered queries: each runs one operator over whole driver tables.

Every query reads the given tables (or data Spark derives from them), so its work grows
with the scale factor. Float aggregates are rounded to 6 places on both sides because sums
in a different order differ in the last bits.
"""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from pressroom.functions.text import NA_TOKENS, STOPWORDS
from pressroom.operators import (articles, audit, boxstats, clean, groups, profile, reports, scores, shares, timeprofile,
                                tokens, visibility)
from pressroom.plans.registry import register
from pressroom.plans.standins import DOC_COMMENTS_SQL, DOC_TEXTS_SQL, doc_comments, doc_texts
from pressroom.sources import links, payload, press_tree, sink
from pressroom.sources.split_csv import load_files
from pressroom.sources.tables import Tables, spread


# ---------------------------------------------------------------- J12 visibility ratios
@register("visibility_by_press", jobs=("J12",), ids=("D2", "H2", "B14"), sql=f"""
WITH {DOC_COMMENTS_SQL}
SELECT press_name, n_hidden, n_shown,
       n_hidden / (n_hidden + n_shown) AS hidden_ratio,
       n_shown / (n_hidden + n_shown) AS shown_ratio
FROM (SELECT press_name, CAST(count_if(NOT visible) AS BIGINT) AS n_hidden, CAST(count_if(visible) AS BIGINT) AS n_shown
      FROM doc_comments WHERE press_name IS NOT NULL AND visible IS NOT NULL
      GROUP BY press_name)
""")
def visibility_by_press(spark: SparkSession, sf_dir: str):
    return visibility.visibility_ratio(doc_comments(Tables(spark, sf_dir)), by="press_name")


@register("visibility_overall", jobs=("J12",), ids=("D1", "F3"), sql=f"""
WITH {DOC_COMMENTS_SQL},
t AS (SELECT CAST(count_if(visible) AS BIGINT) AS n_true, CAST(count_if(NOT visible) AS BIGINT) AS n_false FROM doc_comments)
SELECT visible, n_comments, n_comments / n_total * 100 AS pct FROM (
  SELECT true AS visible, n_true AS n_comments, n_true + n_false AS n_total FROM t
  UNION ALL
  SELECT false, n_false, n_true + n_false FROM t)
WHERE n_comments > 0
ORDER BY n_comments DESC, visible DESC
""")
def visibility_overall(spark: SparkSession, sf_dir: str):
    return visibility.visibility_ratio(doc_comments(Tables(spark, sf_dir)))


# ---------------------------------------------------------------- J9 period filters
def _orders_with_file_name(t: Tables):
    """Orders as 'article files': name ``<yyyy-MM-dd>_<priority>_<key>.csv``."""
    return t.orders.select(
        "o_orderkey", "o_orderdate",
        F.concat_ws("_", F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderpriority",
                    F.col("o_orderkey").cast("string")).alias("stem"),
    ).select("o_orderkey", "o_orderdate", F.concat("stem", F.lit(".csv")).alias("file_name"))


_ORDERS_FILE_SQL = """
f AS (SELECT o_orderkey, o_orderdate,
             strftime(o_orderdate, '%Y-%m-%d') || '_' || o_orderpriority || '_' ||
             CAST(o_orderkey AS VARCHAR) || '.csv' AS file_name
      FROM orders),
p AS (SELECT *, TRY_CAST(split_part(split_part(file_name, '_', 1), '-', 1) AS INTEGER) AS y,
                TRY_CAST(split_part(split_part(file_name, '_', 1), '-', 2) AS INTEGER) AS m
      FROM f)"""


@register("orders_in_period", jobs=("J9",), ids=("B1", "B2"), sql=f"""
WITH {_ORDERS_FILE_SQL}
SELECT o_orderkey, o_orderdate, file_name FROM p
WHERE y IS NOT NULL AND m IS NOT NULL AND y * 100 + m BETWEEN 199601 AND 199706
  AND o_orderdate <= TIMESTAMP '1997-06-15 00:00:00'
""")
def orders_in_period(spark: SparkSession, sf_dir: str):
    files = _orders_with_file_name(Tables(spark, sf_dir))
    kept = clean.filter_name_months(files, "file_name", "1996-01", "1997-06", mode="range")
    return clean.filter_period(kept, "o_orderdate", cutoff="1997-06-15")


@register("orders_months_as_written", jobs=("J9",), ids=("B1",), sql=f"""
WITH {_ORDERS_FILE_SQL}
SELECT strftime(o_orderdate, '%Y-%m') AS year_month, count(*) AS n_files FROM p
WHERE y IS NOT NULL AND m IS NOT NULL AND NOT ((y = 1996 AND m < 12) OR (y = 1998 AND m > 4))
GROUP BY 1
""")
def orders_months_as_written(spark: SparkSession, sf_dir: str):
    files = _orders_with_file_name(Tables(spark, sf_dir))
    kept = clean.filter_name_months(files, "file_name", "1996-12", "1998-04", mode="as_written")
    return (kept.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("year_month"))
                .agg(F.count(F.lit(1)).alias("n_files")))


# ---------------------------------------------------------------- J10 clean comments
_NA_SQL = ", ".join("'" + s.replace("'", "''") + "'" for s in NA_TOKENS)


@register("clean_comments", jobs=("J10",), ids=("B3", "B4", "B5", "B6"), sql=f"""
WITH {DOC_COMMENTS_SQL},
n AS (SELECT doc_id, press_name, quality,
             CASE WHEN comments IN ({_NA_SQL}) THEN NULL ELSE comments END AS comments
      FROM doc_comments)
SELECT doc_id, press_name, CAST(length(comments) AS INTEGER) AS n_chars, coalesce(quality, -1) AS quality
FROM n WHERE comments IS NOT NULL AND regexp_matches(comments, '\\S')
""")
def clean_comments_q(spark: SparkSession, sf_dir: str):
    c = clean.clean_comments(doc_comments(Tables(spark, sf_dir)), text="comments",
                             drop_null=["comments"], drop_blank=True, na_tokens=NA_TOKENS,
                             fill={"quality": -1})
    return c.select("doc_id", "press_name", F.length("comments").alias("n_chars"), "quality")


# ---------------------------------------------------------------- J11 profile / audit / head
@register("null_audit_hidden", jobs=("J11",), ids=("B8",), sql=f"""
WITH {DOC_COMMENTS_SQL}, h AS (SELECT * FROM doc_comments WHERE visible = false)
SELECT 'comments' AS column_name, CAST(count_if(comments IS NULL) AS BIGINT) AS n_null FROM h
UNION ALL SELECT 'quality', CAST(count_if(quality IS NULL) AS BIGINT) FROM h
UNION ALL SELECT 'lang', CAST(count_if(lang IS NULL) AS BIGINT) FROM h
""")
def null_audit_hidden(spark: SparkSession, sf_dir: str):
    c = doc_comments(Tables(spark, sf_dir))
    return profile.null_audit(c, F.col("visible") == F.lit(False), ["comments", "quality", "lang"])


_PROFILE_COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@register("profile_lineitem", jobs=("J11",), ids=("D5",), sql="\nUNION ALL\n".join(f"""
SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 6) AS mean,
       round(stddev_samp({c}), 6) AS std, min({c}) AS min,
       round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
       round(quantile_cont({c}, 0.75), 6) AS p75, max({c}) AS max
FROM lineitem""" for c in _PROFILE_COLS))
def profile_lineitem(spark: SparkSession, sf_dir: str):
    return profile.profile(Tables(spark, sf_dir).lineitem, _PROFILE_COLS)


_ORDERS_TYPES = (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
                 ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"),
                 ("o_orderpriority", "string"))


@register("column_info_orders", jobs=("J11",), ids=("D5",), sql="\nUNION ALL\n".join(
    f"SELECT {i} AS position, '{c}' AS column_name, '{t}' AS dtype, count({c}) AS non_null FROM orders"
    for i, (c, t) in enumerate(_ORDERS_TYPES)))
def column_info_orders(spark: SparkSession, sf_dir: str):
    return profile.column_info(Tables(spark, sf_dir).orders)


@register("head_orders", jobs=("J11",), ids=("F4",), sql="""
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5
""")
def head_orders(spark: SparkSession, sf_dir: str):
    o = Tables(spark, sf_dir).orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return profile.head(o, 5, ["o_orderkey"])


@register("tail_orders", jobs=("J11",), ids=("F4",), sql="""
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 5
""")
def tail_orders(spark: SparkSession, sf_dir: str):
    o = Tables(spark, sf_dir).orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return profile.tail(o, 5, ["o_orderkey"])


# ---------------------------------------------------------------- J13 / J14 time profile
@register("event_time_parts", jobs=("J13",), ids=("B10",), sql="""
SELECT event_id, ts, CAST(year(ts) AS INTEGER) AS year, CAST(hour(ts) AS INTEGER) AS hour,
       dayname(ts) AS weekday, strftime(ts, '%Y-%m') AS year_month
FROM events
""")
def event_time_parts(spark: SparkSession, sf_dir: str):
    e = Tables(spark, sf_dir).events.select("event_id", "ts")
    return timeprofile.time_parts(e, "ts")


@register("hour_histogram", jobs=("J14",), ids=("D3", "F2"), sql="""
SELECT h.hour, coalesce(n_comments, 0) AS n_comments
FROM (SELECT CAST(range AS INTEGER) AS hour FROM range(24)) h
LEFT JOIN (SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n_comments FROM events
           WHERE ts IS NOT NULL GROUP BY 1) c ON h.hour = c.hour
ORDER BY h.hour
""")
def hour_histogram(spark: SparkSession, sf_dir: str):
    return timeprofile.time_histogram(Tables(spark, sf_dir).events, "ts", "hour", dense=True)


@register("weekday_histogram", jobs=("J14",), ids=("D3",), sql="""
SELECT dayname(ts) AS weekday, count(*) AS n_comments FROM events WHERE ts IS NOT NULL GROUP BY 1
""")
def weekday_histogram(spark: SparkSession, sf_dir: str):
    return timeprofile.time_histogram(Tables(spark, sf_dir).events, "ts", "weekday")


@register("month_histogram", jobs=("J14",), ids=("D3", "F2"), sql="""
SELECT strftime(o_orderdate, '%Y-%m') AS year_month, count(*) AS n_comments
FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1 ORDER BY 1
""")
def month_histogram(spark: SparkSession, sf_dir: str):
    return timeprofile.time_histogram(Tables(spark, sf_dir).orders, "o_orderdate", "year_month")


# ---------------------------------------------------------------- J15 / J16 box statistics
def _box_sql(src: str, key: str, cols: tuple[str, ...], metrics: tuple[str, ...] | None = None) -> str:
    metrics = metrics or cols
    parts = []
    for c, m in zip(cols, metrics):
        parts.append(f"""
SELECT s.g AS {key}, '{m}' AS metric, n, round(mean, 6) AS mean, round(q1, 6) AS q1,
       round(med, 6) AS median, round(q3, 6) AS q3,
       min(v) FILTER (WHERE v >= lo AND v <= hi) AS whisker_lo,
       max(v) FILTER (WHERE v >= lo AND v <= hi) AS whisker_hi,
       count(*) FILTER (WHERE v IS NOT NULL AND NOT (v >= lo AND v <= hi)) AS n_outliers
FROM (SELECT g, n, mean, q1, med, q3, q1 - 1.5::DOUBLE * (q3 - q1) AS lo, q3 + 1.5::DOUBLE * (q3 - q1) AS hi
      FROM (SELECT g, count(v) AS n, avg(v) AS mean, quantile_cont(v, 0.25) AS q1,
                   quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.75) AS q3
            FROM (SELECT {key} AS g, CAST({c} AS DOUBLE) AS v FROM {src} WHERE {key} IS NOT NULL)
            GROUP BY g)) s
JOIN (SELECT {key} AS g, CAST({c} AS DOUBLE) AS v FROM {src} WHERE {key} IS NOT NULL) d ON s.g = d.g
WHERE n > 0
GROUP BY s.g, n, mean, q1, med, q3""")
    return "\nUNION ALL\n".join(parts)


@register("box_stats_events", jobs=("J15",), ids=("D4",), sql=_box_sql("events", "event_type", ("value",)))
def box_stats_events(spark: SparkSession, sf_dir: str):
    return boxstats.box_stats(Tables(spark, sf_dir).events, "event_type", ["value"])


@register("box_stats_lineitem", jobs=("J15",), ids=("D4",),
          sql=_box_sql("lineitem", "l_returnflag", ("l_quantity", "l_discount")))
def box_stats_lineitem(spark: SparkSession, sf_dir: str):
    return boxstats.box_stats(Tables(spark, sf_dir).lineitem, "l_returnflag", ["l_quantity", "l_discount"])


@register("length_distribution", jobs=("J16",), ids=("B12", "D4"),
          sql=_box_sql("(SELECT source, length(text) AS comment_length FROM documents)", "source",
                       ("comment_length",)))
def length_distribution(spark: SparkSession, sf_dir: str):
    d = Tables(spark, sf_dir).documents
    return boxstats.length_distribution(d, "source", text="text")


# ---------------------------------------------------------------- J19 press groups
# Caller data for the driver tables: outlets are document sources; "src1" is listed twice
# (the first listing wins for a single assignment, both count for membership).
DOC_GROUPS = {"group 1": ["src0", "src1", "src2"], "group 2": ["src3", "src4", "src5", "src1"]}


def _sql_in(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_GROUP_CASE_SQL = ("CASE " + " ".join(f"WHEN press_name IN ({_sql_in(m)}) THEN '{g}'" for g, m in DOC_GROUPS.items())
                   + " ELSE 'other' END")


@register("group_of_press", jobs=("J19",), ids=("B13", "C3"), sql=f"""
WITH {DOC_TEXTS_SQL}
SELECT press_name, {_GROUP_CASE_SQL} AS "group", count(*) AS n_comments
FROM doc_texts GROUP BY 1, 2
""")
def group_of_press(spark: SparkSession, sf_dir: str):
    c = groups.assign_group(doc_texts(Tables(spark, sf_dir), text_heavy=False), DOC_GROUPS)
    return c.groupBy("press_name", "group").agg(F.count(F.lit(1)).alias("n_comments"))


@register("unlisted_outlets", jobs=("J19",), ids=("C4", "G2", "G3", "D12", "F6"), sql=f"""
SELECT DISTINCT source AS press_name FROM documents
WHERE source IS NOT NULL AND source NOT IN ({_sql_in(groups.group_members(DOC_GROUPS))})
ORDER BY 1
""")
def unlisted_outlets(spark: SparkSession, sf_dir: str):
    return groups.unlisted_outlets(doc_texts(Tables(spark, sf_dir), text_heavy=False), DOC_GROUPS)


# ---------------------------------------------------------------- J20 / J21 / J23 shares
# Stand-in for the monthly emotion summary: per order month x customer segment, the
# quantity shipped under each return flag (three "emotion" columns that partition a total).
SHARE_COLS = ("qty_R", "qty_A", "qty_N")
SEGMENT_GROUPS = {"group 1": ["BUILDING", "AUTOMOBILE"], "group 2": ["MACHINERY", "AUTOMOBILE"]}


def _segment_summary(t: Tables):
    # Eager aggregation: lineitem is summed per order BEFORE the join, so the big join sees
    # one row per order instead of one per line (Catalyst does not push aggregates below joins).
    per_order = t.lineitem.groupBy("l_orderkey").agg(*[
        F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")).otherwise(F.lit(0.0))).alias(f"q_{flag}")
        for flag in ("R", "A", "N")])
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    c = t.customer.select("c_custkey", "c_mktsegment")
    rows = (per_order.join(o, per_order.l_orderkey == o.o_orderkey)
                     .join(c, o.o_custkey == c.c_custkey))
    return shares.build_summary(rows, "o_orderdate", "c_mktsegment",
                                {f"qty_{flag}": F.sum(f"q_{flag}") for flag in ("R", "A", "N")})


_SUMMARY_SQL = """
summary AS (
  SELECT strftime(o.o_orderdate, '%Y-%m') || '-' || c.c_mktsegment AS "Year-Month-Media",
         sum(CASE WHEN l.l_returnflag = 'R' THEN l.l_quantity ELSE 0.0 END) AS qty_R,
         sum(CASE WHEN l.l_returnflag = 'A' THEN l.l_quantity ELSE 0.0 END) AS qty_A,
         sum(CASE WHEN l.l_returnflag = 'N' THEN l.l_quantity ELSE 0.0 END) AS qty_N
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
                  JOIN customer c ON o.o_custkey = c.c_custkey
  WHERE o.o_orderdate IS NOT NULL AND c.c_mktsegment IS NOT NULL
  GROUP BY 1),
long AS (
  SELECT "Year-Month-Media", 'qty_R' AS "Emotion_Type", coalesce(TRY_CAST(qty_R AS DOUBLE), 0.0) AS "Score" FROM summary
  UNION ALL SELECT "Year-Month-Media", 'qty_A', coalesce(TRY_CAST(qty_A AS DOUBLE), 0.0) FROM summary
  UNION ALL SELECT "Year-Month-Media", 'qty_N', coalesce(TRY_CAST(qty_N AS DOUBLE), 0.0) FROM summary),
share AS (
  SELECT l."Year-Month-Media", "Emotion_Type", "Score", "Group_Total_Score",
         CASE WHEN "Group_Total_Score" = 0 THEN 0.0 ELSE "Score" / "Group_Total_Score" * 100 END AS "Ratio",
         split_part(l."Year-Month-Media", '-', 1) || '-' || split_part(l."Year-Month-Media", '-', 2) AS "Year-Month",
         nullif(split_part(l."Year-Month-Media", '-', 3), '') AS "Media_Outlet"
  FROM long l JOIN (SELECT "Year-Month-Media", sum("Score") AS "Group_Total_Score" FROM long GROUP BY 1) t
    ON l."Year-Month-Media" = t."Year-Month-Media")"""


@register("emotion_share", jobs=("J20",), ids=("H1", "E1", "B9", "B11", "B7"), sql=f"""
WITH {_SUMMARY_SQL}
SELECT * FROM share
""")
def emotion_share(spark: SparkSession, sf_dir: str):
    return shares.emotion_share(_segment_summary(Tables(spark, sf_dir)), SHARE_COLS)


@register("group_month_share", jobs=("J23",), ids=("D10", "C6", "H3", "E2", "D12", "F2"), sql=f"""
WITH {_SUMMARY_SQL},
dim AS (SELECT * FROM (VALUES {", ".join(f"('{m}', '{g}')" for g, ms in SEGMENT_GROUPS.items() for m in ms)}) d(press_name, "group")),
rows AS (SELECT coalesce(d."group", 'other') AS "group", s."Year-Month", s."Emotion_Type", s."Ratio"
         FROM share s LEFT JOIN dim d ON s."Media_Outlet" = d.press_name
         WHERE s."Media_Outlet" IS NOT NULL AND s."Year-Month" IS NOT NULL),
means AS (SELECT "group", "Year-Month", "Emotion_Type", avg("Ratio") AS mean_ratio FROM rows GROUP BY 1, 2, 3),
pos AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{e}')" for i, e in enumerate(SHARE_COLS))}) p(pos, "Emotion_Type")),
grid AS (SELECT g."group", g."Year-Month", p.pos, p."Emotion_Type"
         FROM (SELECT DISTINCT "group", "Year-Month" FROM rows) g, pos p),
dense AS (SELECT g.*, coalesce(m.mean_ratio, 0.0) AS mean_ratio FROM grid g
          LEFT JOIN means m USING ("group", "Year-Month", "Emotion_Type")),
st AS (SELECT *, coalesce(sum(mean_ratio) OVER (PARTITION BY "group", "Year-Month" ORDER BY pos
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS start FROM dense)
SELECT "group", "Year-Month", CAST(pos AS INTEGER) AS pos, "Emotion_Type", round(mean_ratio, 6) AS mean_ratio,
       round(start, 6) AS start, round(start + mean_ratio / 2, 6) AS mid,
       CASE WHEN mean_ratio > 5 THEN printf('%.1f%%', round(mean_ratio, 1)) END AS label
FROM st
""")
def group_month_share(spark: SparkSession, sf_dir: str):
    long = shares.emotion_share(_segment_summary(Tables(spark, sf_dir)), SHARE_COLS)
    return shares.group_month_share(long, SEGMENT_GROUPS, order=SHARE_COLS)


_ORDER_SUMMARY_SQL = """
osum AS (
  SELECT CAST(year(o_orderdate) AS VARCHAR) || '-' || CAST(month(o_orderdate) AS VARCHAR) || '-' || o_orderpriority
           AS "Year-Month-Media",
         count(*) AS n_orders, count_if(o_orderstatus = 'O') AS n_open
  FROM orders WHERE o_orderdate IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY 1)"""


def _priority_summary(t: Tables):
    o = t.orders.filter(F.col("o_orderdate").isNotNull() & F.col("o_orderpriority").isNotNull())
    key = F.concat_ws("-", F.year("o_orderdate").cast("string"), F.month("o_orderdate").cast("string"),
                      "o_orderpriority")
    return o.groupBy(key.alias(shares.KEY)).agg(F.count(F.lit(1)).alias("n_orders"),
                                                F.count_if(F.col("o_orderstatus") == "O").alias("n_open"))


@register("conform_summary", jobs=("J21",), ids=("B11", "B9"), sql=f"""
WITH {_ORDER_SUMMARY_SQL}
SELECT "Year-Month-Media",
       split_part("Year-Month-Media", '-', 1) || '-' || lpad(split_part("Year-Month-Media", '-', 2), 2, '0') AS "Year-Month",
       nullif(split_part("Year-Month-Media", '-', 3), '') AS "Media_Outlet",
       CAST(n_orders AS DOUBLE) AS n_orders, CAST(n_open AS DOUBLE) AS n_open, false AS bad_key
FROM osum
""")
def conform_summary(spark: SparkSession, sf_dir: str):
    return shares.conform_summary(_priority_summary(Tables(spark, sf_dir)), ["n_orders", "n_open"])


@register("duplicate_summary_keys", jobs=("J21",), ids=("T5",), sql="""
WITH r AS (
  SELECT strftime(o_orderdate, '%Y-%m') || '-' || o_orderpriority AS "Year-Month-Media", o_orderstatus
  FROM orders WHERE o_orderdate IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY ALL)
SELECT "Year-Month-Media", count(*) AS n_rows FROM r GROUP BY 1 HAVING count(*) > 1
""")
def duplicate_summary_keys(spark: SparkSession, sf_dir: str):
    """A summary with one row per key and order status: keys seen with several statuses repeat."""
    o = Tables(spark, sf_dir).orders.filter(F.col("o_orderdate").isNotNull() & F.col("o_orderpriority").isNotNull())
    key = F.concat_ws("-", F.date_format("o_orderdate", "yyyy-MM"), "o_orderpriority")
    return shares.duplicate_keys(o.select(key.alias(shares.KEY), "o_orderstatus").distinct())


# ---------------------------------------------------------------- J18 keywords
_STOP_SQL = _sql_in(STOPWORDS)


def _tokens_sql(group_expr: str, src: str, n: int) -> str:
    return f"""
t AS (SELECT {group_expr} AS g, unnest(regexp_extract_all(coalesce(comments, ''), '\\p{{L}}+')) AS word FROM {src}),
c AS (SELECT g, word, count(*) AS n FROM t WHERE length(word) >= 2 AND word NOT IN ({_STOP_SQL}) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, word ASC) AS rank FROM c)
SELECT g AS GCOL, CAST(rank AS INTEGER) AS rank, word, n FROM r WHERE rank <= {n}"""


@register("top_tokens_by_lang", jobs=("J18",), ids=("D6", "F1", "U1", "U3", "D11"),
          sql=f"WITH {DOC_TEXTS_SQL}, " + _tokens_sql("lang", "doc_texts", 20).replace("GCOL", "lang"))
def top_tokens_by_lang(spark: SparkSession, sf_dir: str):
    return tokens.top_tokens(doc_texts(Tables(spark, sf_dir)), "lang", n=20)


@register("top_tokens_by_group", jobs=("J18", "J19"), ids=("D6", "F1", "B13"),
          sql=f"WITH {DOC_TEXTS_SQL}, " + _tokens_sql(_GROUP_CASE_SQL, "doc_texts", 30).replace("GCOL", '"group"'))
def top_tokens_by_group(spark: SparkSession, sf_dir: str):
    c = groups.assign_group(doc_texts(Tables(spark, sf_dir)), DOC_GROUPS)
    return tokens.top_tokens(c, "group", n=30)


@register("token_totals_by_lang", jobs=("J18",), ids=("D7",), sql=f"""
WITH {DOC_TEXTS_SQL}
SELECT lang, CAST(sum(len(list_filter(regexp_extract_all(coalesce(comments, ''), '\\p{{L}}+'),
                                    lambda w: length(w) >= 2 AND NOT list_contains([{_STOP_SQL}], w)))) AS BIGINT) AS n_tokens,
       count(*) AS n_comments
FROM doc_texts GROUP BY 1
""")
def token_totals_by_lang(spark: SparkSession, sf_dir: str):
    return tokens.token_totals(doc_texts(Tables(spark, sf_dir)), "lang")


# ---------------------------------------------------------------- J17 / J22 emotion scores
# Demonstration lexicon for the default Catalyst scorer on the driver tables (function-word
# families of the four document languages). A real deployment passes its own scorer.
DEMO_LEXICON = {
    "article": ["the", "a", "an", "le", "la", "les", "der", "die", "das", "el", "los"],
    "conjunction": ["and", "or", "et", "ou", "und", "oder", "y", "o"],
    "preposition": ["of", "in", "on", "to", "de", "des", "du", "von", "zu", "en", "para"],
}


def _doc_lines(t: Tables):
    """Comments = lines of a document; press = source; the document is the 'file' (ordered by
    doc_id) and its language is the period bucket."""
    d = spread(t.documents, "doc_id").select(F.col("source").alias("press_name"), F.col("lang").alias("month"),
                           "doc_id", "text")
    return d.select("press_name", "month", "doc_id", F.explode_outer(F.split("text", "\n")).alias("comments"))


def _scores_sql(scope: str) -> str:
    labels = list(DEMO_LEXICON)
    score_cols = ",\n".join(
        f"CASE WHEN len(toks) > 0 THEN len(list_filter(toks, lambda x: list_contains([{_sql_in(DEMO_LEXICON[lab])}], x)))"
        f" / len(toks) ELSE 0.0 END AS sc{i}" for i, lab in enumerate(labels))
    base = f"""
lines AS (SELECT source AS press_name, lang AS month, doc_id,
                 unnest(CASE WHEN text IS NULL THEN [NULL] ELSE string_split(text, chr(10)) END) AS comments
          FROM documents),
scored AS (SELECT *, coalesce(regexp_matches(comments, '\\S'), false) AS ok,
                  regexp_extract_all(lower(comments), '\\p{{L}}+') AS toks FROM lines WHERE press_name IS NOT NULL),
scored2 AS (SELECT *, {score_cols} FROM scored)"""
    sums = ", ".join(f"sum(CASE WHEN ok THEN sc{i} END) AS s{i}" for i in range(len(labels)))
    means = ", ".join(f"CASE WHEN n_comments = 0 THEN NULL ELSE round(s{i} / n_comments, 6) END AS \"{lab}\""
                      for i, lab in enumerate(labels))
    if scope == "month":
        return f"""WITH {base},
g AS (SELECT press_name, month, CAST(count_if(ok) AS BIGINT) AS n_comments, {sums} FROM scored2 GROUP BY 1, 2)
SELECT press_name, month, n_comments, {means} FROM g"""
    per_file = f"""pf AS (SELECT press_name, month, doc_id, CAST(count_if(ok) AS BIGINT) AS n_comments, {sums}
        FROM scored2 GROUP BY 1, 2, 3)"""
    if scope == "file":
        return f"WITH {base}, {per_file}\nSELECT press_name, month, doc_id, n_comments, {means} FROM pf"
    w = "OVER (PARTITION BY press_name, month ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    run = ", ".join(f"sum(s{i}) {w} AS s{i}" for i in range(len(labels)))
    return f"""WITH {base}, {per_file},
m AS (SELECT press_name, month, doc_id, CAST(sum(n_comments) {w} AS BIGINT) AS n_comments, {run} FROM pf)
SELECT press_name, month, doc_id, n_comments, {means} FROM m"""


@register("mean_scores_month_to_date", jobs=("J17",), ids=("D8", "E3", "U2"), sql=_scores_sql("mtd"))
def mean_scores_month_to_date(spark: SparkSession, sf_dir: str):
    # Files are ordered by doc_id.
    return scores.mean_scores(_doc_lines(Tables(spark, sf_dir)), scores.LexiconScorer(DEMO_LEXICON),
                              file="doc_id", scope="month_to_date")


@register("mean_scores_file", jobs=("J17",), ids=("D8",), sql=_scores_sql("file"))
def mean_scores_file(spark: SparkSession, sf_dir: str):
    return scores.mean_scores(_doc_lines(Tables(spark, sf_dir)), scores.LexiconScorer(DEMO_LEXICON),
                              file="doc_id", scope="file")


@register("mean_scores_month", jobs=("J17",), ids=("D8", "D9"), sql=_scores_sql("month"))
def mean_scores_month(spark: SparkSession, sf_dir: str):
    return scores.mean_scores(_doc_lines(Tables(spark, sf_dir)), scores.LexiconScorer(DEMO_LEXICON),
                              file="doc_id", scope="month")


def _top_emotions_sql(k: int) -> str:
    labels = list(DEMO_LEXICON)
    body = _scores_sql("month")
    head, _ = body.rsplit("SELECT press_name, month, n_comments,", 1)
    means = ", ".join(f"CASE WHEN n_comments = 0 THEN NULL ELSE round(s{i} / n_comments, 6) END AS e{i}"
                      for i in range(len(labels)))
    lng = " UNION ALL ".join(f"SELECT press_name, month, '{lab}' AS emotion, e{i} AS score FROM mm"
                             for i, lab in enumerate(labels))
    return f"""{head.rstrip()},
mm AS (SELECT press_name, month, {means} FROM g),
lng AS ({lng}),
rk AS (SELECT *, row_number() OVER (PARTITION BY press_name, month ORDER BY score DESC, emotion ASC) AS rank
       FROM lng WHERE score IS NOT NULL)
SELECT press_name, month, CAST(rank AS INTEGER) AS rank, emotion, score FROM rk WHERE rank <= {k}"""


@register("top_emotions", jobs=("J22",), ids=("D9", "F5"), sql=_top_emotions_sql(2))
def top_emotions(spark: SparkSession, sf_dir: str):
    m = scores.mean_scores(_doc_lines(Tables(spark, sf_dir)), scores.LexiconScorer(DEMO_LEXICON),
                           file="doc_id", scope="month")
    return scores.top_emotions(m, list(DEMO_LEXICON), ["press_name", "month"], k=2)


# ---------------------------------------------------------------- J3 comment payloads
# Payload stand-in: each conversation is an article; its turns are the comments, landed as
# JSONP pages of PAYLOAD_PAGE rows (small so that articles span several pages).
PAYLOAD_PAGE = 3


def _landed_payload(t: Tables):
    c = t.conversations
    return payload.build_payload(c, "conv_id", "turn", {
        "userName": F.col("role"), "contents": F.col("text"), "visible": F.col("role") == "user",
        "replyLevel": F.lit(0).cast("long"), "sympathyCount": F.col("turn"),
        "antipathyCount": F.length("text").cast("long"), "replyAllCount": F.lit(0).cast("long"),
    }, page_size=PAYLOAD_PAGE).withColumnRenamed("conv_id", "object_id")


@register("explode_payload", jobs=("J3",), ids=("A6", "H4"), sql=f"""
SELECT conv_id AS object_id, CAST(turn // {PAYLOAD_PAGE} + 1 AS BIGINT) AS page,
       CAST(turn % {PAYLOAD_PAGE} AS INTEGER) AS pos, role AS user_nickname, CAST(NULL AS VARCHAR) AS userIdNo,
       text AS comments, role = 'user' AS visible, CAST(0 AS BIGINT) AS replyLevel,
       CAST(NULL AS VARCHAR) AS regTime, CAST(NULL AS VARCHAR) AS parentCommentNo, turn AS sympathyCount,
       CAST(length(text) AS BIGINT) AS antipathyCount, CAST(0 AS BIGINT) AS replyAllCount
FROM conversations
""")
def explode_payload_q(spark: SparkSession, sf_dir: str):
    return payload.explode_payload(_landed_payload(Tables(spark, sf_dir)))


@register("payload_completeness", jobs=("J3",), ids=("A14",), sql=f"""
SELECT conv_id AS object_id, count(DISTINCT turn // {PAYLOAD_PAGE}) AS n_pages, count(*) AS n_rows,
       count(*) % {PAYLOAD_PAGE} <> 0 AS complete
FROM conversations GROUP BY 1
""")
def payload_completeness(spark: SparkSession, sf_dir: str):
    return payload.page_report(_landed_payload(Tables(spark, sf_dir)), page_size=PAYLOAD_PAGE)


@register("event_props", jobs=("J3",), ids=("A6",), sql="""
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events
""")
def event_props(spark: SparkSession, sf_dir: str):
    e = Tables(spark, sf_dir).events
    return e.select("event_id", payload.json_field("props", "k bigint").getField("k").alias("k"))


# ---------------------------------------------------------------- J4 / J5 articles and links
CRAWL_DAY = "2024-12-04"
_TITLE_RE = "<title>(.*?)</title>"


def _page_articles(t: Tables):
    p = t.pages
    return p.select("page_id", "url", F.regexp_extract("html", _TITLE_RE, 1).alias("title"),
                    F.to_date(F.lit(CRAWL_DAY)).alias("day"))


@register("article_index", jobs=("J4",), ids=("B16", "B17", "B18", "G4"), sql=f"""
WITH p AS (SELECT url, regexp_extract(html, '{_TITLE_RE}', 1) AS title, DATE '{CRAWL_DAY}' AS day,
                  string_split(split_part(url, '?', 1), '/') AS parts FROM pages),
k AS (SELECT *, CASE WHEN len(parts) >= 2 THEN parts[-2] END AS press_id,
                CASE WHEN len(parts) >= 2 THEN parts[-1] END AS article_id FROM p),
o AS (SELECT *, 'news' || press_id || ',' || article_id AS object_id FROM k WHERE press_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY day, url) AS rn,
             count(*) OVER (PARTITION BY object_id) AS n_copies,
             min(day) OVER (PARTITION BY object_id) AS first_day FROM o)
SELECT object_id, press_id, article_id, first_day, url,
       regexp_replace(title, '{articles.UNSAFE_TITLE}', '_', 'g') AS safe_title,
       CAST(day AS VARCHAR) || '_' || press_id || '_' || regexp_replace(title, '{articles.UNSAFE_TITLE}', '_', 'g') || '.csv'
         AS file_name,
       n_copies
FROM r WHERE rn = 1
""")
def article_index(spark: SparkSession, sf_dir: str):
    return articles.article_index(_page_articles(Tables(spark, sf_dir)), "url", "title", "day")


# Anchors as the driver's pages write them.
_ANCHOR_SQL = r'<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'
_LINKS_SQL = f"""
a AS (SELECT page_id, regexp_extract_all(html, '{_ANCHOR_SQL}', 1) AS hrefs,
             regexp_extract_all(html, '{_ANCHOR_SQL}', 2) AS inners FROM pages),
u AS (SELECT page_id, unnest(hrefs) AS href, unnest(inners) AS ihtml,
             unnest(generate_series(0, len(hrefs) - 1)) AS pos FROM a),
l AS (SELECT page_id, CAST(pos AS INTEGER) AS pos, replace(replace(href, '&quot;', '"'), '&amp;', '&') AS href,
             regexp_replace(regexp_replace(CASE WHEN regexp_matches(ihtml, '{links.SPAN}')
                                                THEN regexp_extract(ihtml, '{links.SPAN}', 1) ELSE ihtml END,
                                           '{links.TAG}', '', 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM u)"""


@register("extract_links", jobs=("J5",), ids=("A11", "C5"), sql=f"WITH {_LINKS_SQL}\nSELECT * FROM l")
def extract_links_q(spark: SparkSession, sf_dir: str):
    return links.extract_links(Tables(spark, sf_dir).pages, "html", "page_id")


@register("distinct_links", jobs=("J5",), ids=("G4", "B15"), sql=f"""
WITH {_LINKS_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY href ORDER BY page_id, pos) AS rn FROM l WHERE contains(href, '/'))
SELECT page_id, pos, href, text FROM r WHERE rn = 1
""")
def distinct_links(spark: SparkSession, sf_dir: str):
    return links.extract_links(Tables(spark, sf_dir).pages, "html", "page_id", contains="/", distinct=True)


@register("url_query_param", jobs=("J5", "J6"), ids=("A12",), sql="""
SELECT page_id, nullif(regexp_extract(split_part(split_part(url, '#', 1), '?', 2), '(?:^|&)page=([^&]*)', 1), '') AS page FROM pages
""")
def url_query_param(spark: SparkSession, sf_dir: str):
    p = Tables(spark, sf_dir).pages
    return p.select("page_id", links.query_value(F.col("url"), "page").alias("page"))


# ---------------------------------------------------------------- J6 press lookup
@register("lookup_nation_name", jobs=("J6",), ids=("C1", "A12"), sql="""
SELECT c.c_custkey, c.c_nationkey, n.n_name AS press_name
FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
""")
def lookup_nation_name(spark: SparkSession, sf_dir: str):
    t = Tables(spark, sf_dir)
    return articles.lookup_press(t.customer.select("c_custkey", "c_nationkey"), t.nation,
                                 "c_nationkey", "n_nationkey", "n_name")


@register("lookup_customer_name", jobs=("J6",), ids=("C1",), sql="""
SELECT o.o_orderkey, o.o_custkey, c.c_name AS press_name
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
""")
def lookup_customer_name(spark: SparkSession, sf_dir: str):
    t = Tables(spark, sf_dir)
    return articles.lookup_press(t.orders.select("o_orderkey", "o_custkey"), t.customer,
                                 "o_custkey", "c_custkey", "c_name")


# ---------------------------------------------------------------- J7 day coverage
@register("day_coverage", jobs=("J7",), ids=("A13",), sql="""
WITH r AS (SELECT event_type, CAST(ts AS DATE) AS day FROM events WHERE event_type IS NOT NULL),
c AS (SELECT event_type, day, count(*) AS n_rows FROM r
      WHERE day BETWEEN DATE '2023-12-28' AND DATE '2024-02-03' GROUP BY 1, 2),
g AS (SELECT t.event_type, CAST(d.generate_series AS DATE) AS day
      FROM (SELECT DISTINCT event_type FROM r) t,
           generate_series(DATE '2023-12-28', DATE '2024-02-03', INTERVAL 1 DAY) d)
SELECT g.event_type, g.day, coalesce(c.n_rows, 0) AS n_rows FROM g LEFT JOIN c USING (event_type, day)
""")
def day_coverage(spark: SparkSession, sf_dir: str):
    return articles.day_coverage(Tables(spark, sf_dir).events, "ts", "event_type", "2023-12-28", "2024-02-03")


# ---------------------------------------------------------------- J8 ingest audit / J2 first fetch
_AUDIT_SQL = """
e AS (SELECT event_id, ts, user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS n_comments,
             coalesce(event_type = 'error', false) AS failed FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, failed ORDER BY ts, event_id) AS rn FROM e),
s AS (SELECT *, CASE WHEN failed THEN 'failed' WHEN rn = 1 THEN 'ok' ELSE 'duplicate' END AS status FROM f),
a AS (SELECT event_id, ts, user_id, event_type, n_comments, status,
        CAST(count(*) OVER w AS BIGINT) AS seq,
        CAST(sum(CASE WHEN status = 'ok' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS ok_count,
        CAST(sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS fail_count,
        CAST(sum(CASE WHEN status = 'failed' THEN 0 ELSE coalesce(n_comments, 0) END) OVER w AS BIGINT) AS total_comments
      FROM s WINDOW w AS (ORDER BY ts ASC NULLS FIRST, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def _audit(t: Tables):
    e = t.events.select("event_id", "ts", "user_id", "event_type", "props")
    return audit.ingest_audit(e, ["user_id", "event_type"], "ts", "event_id",
                              failed=F.col("event_type") == "error",
                              n_comments=payload.json_field("props", "k bigint").getField("k")).drop("props")


@register("ingest_audit", jobs=("J8",), ids=("A10", "E4"), sql=f"""
WITH {_AUDIT_SQL}
SELECT event_id, ts, user_id, event_type, n_comments, status, seq, ok_count, fail_count, total_comments FROM a
""")
def ingest_audit(spark: SparkSession, sf_dir: str):
    return _audit(Tables(spark, sf_dir)).select(
        "event_id", "ts", "user_id", "event_type", "n_comments", "status", "seq", "ok_count", "fail_count",
        "total_comments")


@register("audit_totals", jobs=("J8",), ids=("D13",), sql=f"""
WITH {_AUDIT_SQL}
SELECT status, count(*) AS n_fetches, CAST(sum(coalesce(n_comments, 0)) AS BIGINT) AS n_comments FROM a GROUP BY 1
""")
def audit_totals(spark: SparkSession, sf_dir: str):
    e = Tables(spark, sf_dir).events.select("event_id", "ts", "user_id", "event_type", "props")
    e = e.withColumn("n_comments", payload.json_field("props", "k bigint").getField("k"))
    statuses = audit.fetch_status(e, ["user_id", "event_type"], "ts", "event_id",
                                  failed=F.col("event_type") == "error")
    return audit.audit_totals(statuses)


@register("first_fetch_per_key", jobs=("J2",), ids=("G5",), sql="""
SELECT e.event_id, e.user_id, e.event_type, e.ts
FROM events e JOIN (SELECT user_id, event_type, min(ts) AS m FROM events GROUP BY 1, 2) f
  ON e.user_id IS NOT DISTINCT FROM f.user_id AND e.event_type IS NOT DISTINCT FROM f.event_type AND e.ts IS NOT DISTINCT FROM f.m
""")
def first_fetch_per_key(spark: SparkSession, sf_dir: str):
    e = Tables(spark, sf_dir).events.select("event_id", "user_id", "event_type", "ts")
    return sink.first_fetch(e, ["user_id", "event_type"], "ts").select("event_id", "user_id", "event_type", "ts")


# ---------------------------------------------------------------- J1 / J24 ingest round trips
def _events_as_comments(t: Tables):
    """Events as article comments: press = event type, one article file per day."""
    return t.events.select(
        F.col("event_type").alias("press_name"), F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.col("user_id").cast("string").alias("user_nickname"), F.col("props").alias("comments"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("regTime"), F.col("event_id").alias("sympathyCount"))


@register("press_tree_roundtrip", jobs=("J1", "J2"), ids=("A4", "A7", "B20"), sql="""
SELECT event_type AS press_name, strftime(ts, '%Y-%m-%d') AS date, CAST(user_id AS VARCHAR) AS user_nickname,
       props AS comments, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS regTime, event_id AS sympathyCount
FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL
""")
def press_tree_roundtrip(spark: SparkSession, sf_dir: str):
    """Writes the events as a partitioned CSV comment tree (the J2 sink layout) into the
    shared checkpoint folder, then ingests it back with J1."""
    from pressroom.session import scratch_path
    root = scratch_path(spark, "press-tree")
    rows = _events_as_comments(Tables(spark, sf_dir)).filter(F.col("press_name").isNotNull() & F.col("date").isNotNull())
    sink.write_table(rows, root, partition_by=["press_name", "date"], fmt="csv")
    comments, _ = press_tree.ingest_press_tree(spark, root, layout="partitioned", extra_columns=False)
    return comments.select("press_name", "date", "user_nickname", "comments", "regTime", "sympathyCount")


@register("stream_first_fetch", jobs=("J24",), ids=("S1", "G5"), sql="""
SELECT e.event_id, e.user_id, e.event_type, e.ts
FROM events e JOIN (SELECT user_id, event_type, min(ts) AS m FROM events GROUP BY 1, 2) f
  ON e.user_id = f.user_id AND e.event_type = f.event_type AND e.ts = f.m
""")
def stream_first_fetch(spark: SparkSession, sf_dir: str):
    """Structured Streaming over the events table file: per micro-batch first fetch per
    (user, type), anti-joined with the sink, appended; the result is the sink."""
    from pressroom.session import scratch_path
    from pressroom.streaming import ingest
    base = scratch_path(spark, "stream")
    schema = Tables(spark, sf_dir).events.schema
    ingest.stream_ingest(spark, sf_dir, f"{base}/sink", f"{base}/checkpoint", schema,
                         key=["user_id", "event_type"], order="ts", partition_by=["event_type"],
                         audit=f"{base}/audit", glob_filter="events.parquet")
    return ingest.read_sink(spark, f"{base}/sink").select("event_id", "user_id", "event_type", "ts")


# ---------------------------------------------------------------- J14 dense / J19 members
@register("weekday_histogram_dense", jobs=("J14",), ids=("D3", "F2"), sql="""
WITH d(weekday, pos) AS (VALUES ('Monday', 1), ('Tuesday', 2), ('Wednesday', 3), ('Thursday', 4),
                                ('Friday', 5), ('Saturday', 6), ('Sunday', 7)),
c AS (SELECT dayname(o_orderdate) AS weekday, count(*) AS n_comments FROM orders
      WHERE o_orderdate IS NOT NULL GROUP BY 1)
SELECT d.weekday, coalesce(c.n_comments, 0) AS n_comments FROM d LEFT JOIN c USING (weekday) ORDER BY d.pos
""")
def weekday_histogram_dense(spark: SparkSession, sf_dir: str):
    return timeprofile.time_histogram(Tables(spark, sf_dir).orders, "o_orderdate", "weekday", dense=True)


@register("comments_of_members", jobs=("J19",), ids=("B14", "C3", "G3"), sql=f"""
SELECT source AS press_name, count(*) AS n_comments, CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM documents WHERE source IN ({_sql_in(groups.group_members(DOC_GROUPS))}) GROUP BY 1
""")
def comments_of_members(spark: SparkSession, sf_dir: str):
    c = groups.filter_members(doc_texts(Tables(spark, sf_dir), text_heavy=False), groups.group_members(DOC_GROUPS))
    return c.groupBy("press_name").agg(F.count(F.lit(1)).alias("n_comments"),
                                       F.sum(F.length("comments")).cast("long").alias("n_chars"))


@register("month_histogram_dense", jobs=("J14",), ids=("D3", "F2"), sql="""
WITH c AS (SELECT strftime(o_orderdate, '%Y-%m') AS year_month, count(*) AS n_comments
           FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1),
d AS (SELECT strftime(m, '%Y-%m') AS year_month
      FROM (SELECT min(year_month) AS lo, max(year_month) AS hi FROM c) b,
           generate_series(CAST(lo || '-01' AS DATE), CAST(hi || '-01' AS DATE), INTERVAL 1 MONTH) g(m))
SELECT d.year_month, coalesce(c.n_comments, 0) AS n_comments FROM d LEFT JOIN c USING (year_month)
ORDER BY 1
""")
def month_histogram_dense(spark: SparkSession, sf_dir: str):
    """Orders per month over the whole span, months without any -> 0."""
    return timeprofile.time_histogram(Tables(spark, sf_dir).orders, "o_orderdate", "year_month", dense=True)


# ---------------------------------------------------------------- NaN, continuous values
@register("emotion_share_nan", jobs=("J20",), ids=("E1", "B9", "B6"), sql="""
WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') || '-' || o_orderpriority AS k, o_orderstatus AS st, o_totalprice AS p
           FROM orders WHERE o_orderdate IS NOT NULL AND o_orderpriority IS NOT NULL),
s AS (SELECT k, coalesce(sum(CASE WHEN st = 'O' THEN 1.0 ELSE 0.0 END), 0) AS n_o,
             CASE WHEN count_if(st = 'P') % 2 = 0 THEN 0.0 ELSE CAST(count_if(st = 'P') AS DOUBLE) END AS n_p FROM o GROUP BY 1),
l AS (SELECT k, 'n_o' AS e, CAST(n_o AS DOUBLE) AS v FROM s UNION ALL SELECT k, 'n_p', n_p FROM s),
t AS (SELECT k, sum(v) AS total FROM l GROUP BY 1)
SELECT l.k AS "Year-Month-Media", e AS "Emotion_Type", v AS "Score", total AS "Group_Total_Score",
       CASE WHEN total = 0 THEN 0.0 ELSE v / total * 100 END AS "Ratio",
       split_part(l.k, '-', 1) || '-' || split_part(l.k, '-', 2) AS "Year-Month", nullif(split_part(l.k, '-', 3), '') AS "Media_Outlet"
FROM l JOIN t ON l.k = t.k
""")
def emotion_share_nan(spark: SparkSession, sf_dir: str):
    """A text summary where even counts of one column came out as ``NaN``: they count as 0."""
    o = Tables(spark, sf_dir).orders.filter(F.col("o_orderdate").isNotNull() & F.col("o_orderpriority").isNotNull())
    n_p = F.count_if(F.col("o_orderstatus") == "P")
    summary = o.groupBy(F.concat_ws("-", F.date_format("o_orderdate", "yyyy-MM"), "o_orderpriority").alias(shares.KEY)).agg(
        F.count_if(F.col("o_orderstatus") == "O").cast("string").alias("n_o"),
        F.when(n_p % 2 == 0, "NaN").otherwise(n_p.cast("string")).alias("n_p"))
    return shares.emotion_share(summary, ["n_o", "n_p"])


@register("profile_orders_nan", jobs=("J11",), ids=("D5", "B8"), sql="""
SELECT 'price' AS column_name, count(v) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min,
       round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75, max(v) AS max
FROM (SELECT CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS v FROM orders)
""")
def profile_orders_nan(spark: SparkSession, sf_dir: str):
    """A continuous column with NaN where the order is pending: NaN is no value."""
    o = Tables(spark, sf_dir).orders
    return profile.profile(o.select(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).otherwise(F.lit(float("nan"))).alias("price")))


@register("box_stats_orders", jobs=("J15",), ids=("D4",), sql=_box_sql("orders", "o_orderpriority", ("o_totalprice",)))
def box_stats_orders(spark: SparkSession, sf_dir: str):
    return boxstats.box_stats(Tables(spark, sf_dir).orders, "o_orderpriority", ["o_totalprice"])


# ---------------------------------------------------------------- J2 / J24 several batches, null keys
_KEYED_EVENTS_SQL = """k AS (SELECT event_id, user_id, nullif(event_type, 'error') AS press_name, date_trunc('hour', ts) AS fetched FROM events)"""


def _keyed_events(t: Tables):
    """Events as fetches: the key holds nulls, the order has ties."""
    press = F.when(F.col("event_type") != "error", F.col("event_type"))
    return t.events.select("event_id", "user_id", press.alias("press_name"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("fetched"))


@register("first_fetch_null_keys", jobs=("J2",), ids=("G5",), sql=f"""
WITH {_KEYED_EVENTS_SQL}, f AS (SELECT user_id, press_name, min(fetched) AS m FROM k GROUP BY 1, 2)
SELECT k.* FROM k JOIN f ON k.user_id IS NOT DISTINCT FROM f.user_id AND k.press_name IS NOT DISTINCT FROM f.press_name AND k.fetched = f.m
""")
def first_fetch_null_keys(spark: SparkSession, sf_dir: str):
    return sink.first_fetch(_keyed_events(Tables(spark, sf_dir)), ["user_id", "press_name"], "fetched")


@register("sink_two_runs", jobs=("J2",), ids=("A7", "C2", "G5"), sql=f"""
WITH {_KEYED_EVENTS_SQL},
mid AS (SELECT min(fetched) + (max(fetched) - min(fetched)) / 2 AS m FROM k),
a AS (SELECT k.* FROM k, mid WHERE fetched <= m),
fa AS (SELECT user_id, press_name, min(fetched) AS f FROM a GROUP BY 1, 2),
fk AS (SELECT user_id, press_name, min(fetched) AS f FROM k GROUP BY 1, 2)
SELECT k.* FROM k JOIN fk ON k.user_id IS NOT DISTINCT FROM fk.user_id AND k.press_name IS NOT DISTINCT FROM fk.press_name AND k.fetched = fk.f
""")
def sink_two_runs(spark: SparkSession, sf_dir: str):
    """Two runs into one sink: the earlier half, then everything. The second run adds only keys that
    the sink does not hold, null keys included."""
    from pressroom.session import scratch_path
    root = scratch_path(spark, "sink")
    rows = _keyed_events(Tables(spark, sf_dir))
    lo, hi = rows.agg(F.min("fetched"), F.max("fetched")).first()
    half = rows.filter(F.col("fetched") <= F.lit(lo + (hi - lo) / 2)) if lo is not None else rows
    for part in (half, rows):
        sink.write_new_articles(part, root, ["user_id", "press_name"], "fetched", partition_by=["press_name"])
    return spark.read.parquet(root).select("event_id", "user_id", "press_name", "fetched")


@register("sink_key_filter", jobs=("J2",), ids=("C2", "G5"), sql=f"""
WITH {_KEYED_EVENTS_SQL}, f AS (SELECT user_id, min(fetched) AS m FROM k GROUP BY 1)
SELECT k.* FROM k JOIN f ON k.user_id IS NOT DISTINCT FROM f.user_id AND k.fetched = f.m
""")
def sink_key_filter(spark: SparkSession, sf_dir: str):
    """Two runs into one sink whose folders are no part of the key: the earlier half, then everything. The
    second run reads the folders that the filters of the first name."""
    from pressroom.session import scratch_path
    from pressroom.sources import key_filter
    root = scratch_path(spark, "sink")
    rows = _keyed_events(Tables(spark, sf_dir))
    lo, hi = rows.agg(F.min("fetched"), F.max("fetched")).first()
    half = rows.filter(F.col("fetched") <= F.lit(lo + (hi - lo) / 2)) if lo is not None else rows
    for part in (half, rows):
        key_filter.write_filtered(part, root, ["user_id"], "fetched", ["press_name"])
    return spark.read.parquet(root).select("event_id", "user_id", "press_name", "fetched")


@register("stream_three_batches", jobs=("J24",), ids=("S1", "C2", "G5"), sql=f"""
WITH {_KEYED_EVENTS_SQL}, f AS (SELECT user_id, press_name, min(fetched) AS m FROM k GROUP BY 1, 2)
SELECT k.* FROM k JOIN f ON k.user_id IS NOT DISTINCT FROM f.user_id AND k.press_name IS NOT DISTINCT FROM f.press_name AND k.fetched = f.m
""")
def stream_three_batches(spark: SparkSession, sf_dir: str):
    """The fetches land in three portions in time order, so articles are split between them and known
    keys come again; after each the stream runs once. The sink holds each key's first fetch, whole."""
    from pressroom.session import cut_lineage, scratch_path
    from pressroom.streaming import ingest
    base = scratch_path(spark, "stream")
    rows = _keyed_events(Tables(spark, sf_dir))
    dealt = cut_lineage(rows.repartitionByRange(3, "fetched", "event_id").withColumn("portion", F.spark_partition_id()))
    for portion in range(3):
        dealt.filter(F.col("portion") == portion).drop("portion").write.mode("append").parquet(f"{base}/landed")
        ingest.stream_ingest(spark, f"{base}/landed", f"{base}/sink", f"{base}/checkpoint", rows.schema,
                             key=["user_id", "press_name"], order="fetched", partition_by=["press_name"], glob_filter="*.parquet")
    return ingest.read_sink(spark, f"{base}/sink").select("event_id", "user_id", "press_name", "fetched")


# ---------------------------------------------------------------- J3 damaged payloads
def _damaged_payload(t: Tables):
    """The landed pages, those of every article's first page twice, and second pages cut off."""
    pages = _landed_payload(t)
    broken = F.expr("substring(payload, 1, 20)")
    return (pages.withColumn("payload", F.when(F.col("page") == 2, broken).otherwise(F.col("payload")))
                 .unionByName(pages.filter(F.col("page") == 1)))


@register("payload_damaged_rows", jobs=("J3",), ids=("A6", "H4"), sql=f"""
SELECT conv_id AS object_id, CAST(turn // {PAYLOAD_PAGE} + 1 AS BIGINT) AS page, CAST(turn % {PAYLOAD_PAGE} AS INTEGER) AS pos, text AS comments
FROM conversations WHERE turn // {PAYLOAD_PAGE} <> 1
""")
def payload_damaged_rows(spark: SparkSession, sf_dir: str):
    return payload.explode_payload(_damaged_payload(Tables(spark, sf_dir))).select("object_id", "page", "pos", "comments")


@register("payload_rejects", jobs=("J3",), ids=("A6",), sql=f"""
SELECT DISTINCT conv_id AS object_id, CAST(2 AS BIGINT) AS page, 20 AS n_bytes FROM conversations WHERE turn // {PAYLOAD_PAGE} = 1
""")
def payload_rejects(spark: SparkSession, sf_dir: str):
    return payload.payload_rejects(_damaged_payload(Tables(spark, sf_dir)))


@register("payload_damaged_completeness", jobs=("J3",), ids=("A14",), sql=f"""
WITH p AS (SELECT conv_id, turn // {PAYLOAD_PAGE} AS page, CASE WHEN turn // {PAYLOAD_PAGE} = 1 THEN 0 ELSE 1 END AS ok FROM conversations)
SELECT conv_id AS object_id, count(DISTINCT page) AS n_pages, CAST(sum(ok) AS BIGINT) AS n_rows,
       (max(page) = 0 AND sum(ok) < {PAYLOAD_PAGE}) OR (max(page) = 1) AS complete
FROM p GROUP BY 1
""")
def payload_damaged_completeness(spark: SparkSession, sf_dir: str):
    """A cut-off page counts as empty: an article is complete only if that is its last page."""
    return payload.page_report(_damaged_payload(Tables(spark, sf_dir)), page_size=PAYLOAD_PAGE)


# ---------------------------------------------------------------- J17 by label name, J18 by month, reports
def _length_scorer(texts):
    """A stand-in model: scores by label, in its own order, with one label nobody asked for."""
    return [[{"label": "unasked", "score": 1.0}, {"label": "spaces", "score": t.count(" ")}, {"label": "length", "score": len(t)}] for t in texts]


@register("mean_scores_by_label", jobs=("J17",), ids=("C7", "U2", "D8"), sql="""
WITH l AS (SELECT source AS press_name, lang AS month, doc_id, unnest(string_split(text, chr(10))) AS c FROM documents),
s AS (SELECT press_name, month, doc_id, count(c) FILTER (WHERE regexp_matches(c, '\\S')) AS n,
             sum(length(c)) FILTER (WHERE regexp_matches(c, '\\S')) AS chars,
             sum(length(c) - length(replace(c, ' ', ''))) FILTER (WHERE regexp_matches(c, '\\S')) AS spaces
      FROM l WHERE press_name IS NOT NULL GROUP BY 1, 2, 3)
SELECT press_name, month, doc_id, n AS n_comments, CASE WHEN n > 0 THEN round(chars / n, 6) END AS length,
       CASE WHEN n > 0 THEN CAST(0.0 AS DOUBLE) END AS absent, CASE WHEN n > 0 THEN round(spaces / n, 6) END AS spaces FROM s
""")
def mean_scores_by_label(spark: SparkSession, sf_dir: str):
    scorer = scores.pandas_scorer(_length_scorer, ["length", "absent", "spaces"])
    return scores.mean_scores(_doc_lines(Tables(spark, sf_dir)), scorer, file="doc_id", scope="file")


@register("monthly_keywords", jobs=("J18",), ids=("U4", "D6", "B2"), sql="WITH m AS ("
          "SELECT p_name AS comments, strftime(l_shipdate, '%Y-%m') AS ym FROM lineitem JOIN part ON l_partkey = p_partkey "
          "WHERE p_name IS NOT NULL AND l_shipdate <= DATE '2000-06-30'), " + _tokens_sql("ym", "m", 5).replace("GCOL", "year_month"))
def monthly_keywords(spark: SparkSession, sf_dir: str):
    t = Tables(spark, sf_dir)
    sold = t.lineitem.select("l_partkey", F.col("l_shipdate").alias("regTime")).join(
        t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("comments")), "l_partkey")
    return reports.monthly_keywords(sold, n=5, cutoff="2000-06-30")[0]


@register("press_directory", jobs=("J5", "J6"), ids=("A12",), sql=f"""
WITH l AS (SELECT page_id, regexp_extract(split_part(split_part(url, '#', 1), '?', 2), '(?:^|&)page=([^&]*)', 1) AS press_id,
                  regexp_extract(html, '{_TITLE_RE}', 1) AS title FROM pages)
SELECT press_id, min_by(title, page_id) AS press_name FROM l WHERE press_id <> '' GROUP BY 1
""")
def press_directory(spark: SparkSession, sf_dir: str):
    """Pages as links of a directory: the id is a query value of the url, the name the title."""
    rows = Tables(spark, sf_dir).pages.select("page_id", F.col("url").alias("href"), F.regexp_extract("html", _TITLE_RE, 1).alias("text"))
    return links.press_directory(rows, param="page")


_DATED_FILE_SQL = "'2024-' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || '_' || source || '_' || doc_id || '.csv'"


def _dated_files(t: Tables):
    """Documents as article files with a date in the name; their lines are the comments."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    month = F.concat(F.lit("2024-"), two(F.col("doc_id") % 12 + 1))
    name = F.concat(month, F.lit("-"), two(F.col("doc_id") % 28 + 1), F.lit("_"), "source", F.lit("_"), "doc_id", F.lit(".csv"))
    d = spread(t.documents, "doc_id").filter(F.col("source").isNotNull())
    return d.select(F.col("source").alias("press_name"), month.alias("month"), name.alias("file_name"),
                    F.explode_outer(F.split("text", "\n")).alias("comments"))


@register("score_table", jobs=("J17",), ids=("A8", "B19", "B20"), sql=f"""
WITH l AS (SELECT source AS press_name, {_DATED_FILE_SQL} AS f, unnest(string_split(text, chr(10))) AS c FROM documents WHERE source IS NOT NULL),
s AS (SELECT press_name, f, count(c) FILTER (WHERE regexp_matches(c, '\\S')) AS n, sum(length(c)) FILTER (WHERE regexp_matches(c, '\\S')) AS chars FROM l GROUP BY 1, 2)
SELECT press_name, f[1:10] AS "year-month-day", CASE WHEN n > 0 THEN round(chars / n, 6) END AS length FROM s
""")
def score_table(spark: SparkSession, sf_dir: str):
    """Mean score per file, as the per-press table, written one folder per press and read back."""
    from pressroom.session import scratch_path
    scored = scores.mean_scores(_dated_files(Tables(spark, sf_dir)), scores.pandas_scorer(_length_scorer, ["length"]), scope="file")
    root = scratch_path(spark, "score-table")
    sink.write_table(scores.score_table(scored, ["length"]), root, partition_by=["press_name"])
    return spark.read.parquet(root).select("press_name", "year-month-day", "length")


@register("emotion_report", jobs=("J17", "J20", "J23"), ids=("D8", "E1", "D10", "H1"), sql="""
WITH l AS (SELECT source AS press_name, '2024-' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') AS month, unnest(string_split(text, chr(10))) AS c
           FROM documents WHERE source IS NOT NULL),
s AS (SELECT press_name, month, round(sum(length(c)) / count(c), 6) AS length, round(sum(length(c) - length(replace(c, ' ', ''))) / count(c), 6) AS spaces
      FROM l WHERE regexp_matches(c, '\\S') GROUP BY 1, 2),
e AS (SELECT month || '-' || press_name AS k, month, press_name, 'length' AS e, length AS v, length + spaces AS total FROM s
      UNION ALL SELECT month || '-' || press_name, month, press_name, 'spaces', spaces, length + spaces FROM s)
SELECT k AS "Year-Month-Media", e AS "Emotion_Type", v AS "Score", round(total, 6) AS "Group_Total_Score",
       round(CASE WHEN total = 0 THEN 0.0 ELSE v / total * 100 END, 6) AS "Ratio", month AS "Year-Month", press_name AS "Media_Outlet" FROM e
""")
def emotion_report(spark: SparkSession, sf_dir: str):
    """Comments -> month scores -> summary -> shares, as one chain."""
    _, shares_long, _ = reports.emotion_report(_dated_files(Tables(spark, sf_dir)), scores.pandas_scorer(_length_scorer, ["length", "spaces"]), DOC_GROUPS)
    return shares_long.withColumns({c: F.round(c, 6) for c in ("Group_Total_Score", "Ratio")})


# ---------------------------------------------------------------- J1 the raw press layout
ARTICLE_ROWS = 500
# Two ways the files of a press are written: encoding and order of the columns.
RAW_KINDS = (("utf-8", ("user_nickname", "comments", "regTime", "sympathyCount")),
             ("cp949", ("sympathyCount", "regTime", "comments", "user_nickname")))


def _write_raw_tree(rows, root: str) -> None:
    """Writes ``<root>/<press>/<date>_<press>_<title>.csv``, at most ARTICLE_ROWS rows a file. Every
    task names its files by its own number, so a task that is run again writes the same ones."""
    kinds = RAW_KINDS

    def encode(batches):
        import csv
        import io

        import pandas as pd
        from pyspark import TaskContext
        number = 0
        for pdf in batches:
            out = []
            for (press, date), group in pdf.groupby(["press_name", "date"], sort=True):
                for at in range(0, len(group), ARTICLE_ROWS):
                    encoding, columns = kinds[len(press) % len(kinds)]
                    text = io.StringIO(newline="")
                    writer = csv.writer(text)
                    writer.writerow(columns)
                    writer.writerows(group.iloc[at: at + ARTICLE_ROWS][list(columns)].itertuples(index=False, name=None))
                    name = f"{date}_{press}_t{TaskContext.get().partitionId()}n{number}.csv"
                    out.append((press, name, text.getvalue().removesuffix("\r\n").encode(encoding)))
                    number += 1
            yield pd.DataFrame(out, columns=["press_name", "file_name", "content"])

    # an article's rows in one task
    rows = rows.repartition("press_name", "date").sortWithinPartitions("press_name", "date")
    sink.write_article_files(rows.mapInPandas(encode, "press_name string, file_name string, content binary"), root)


def _raw_comments(t: Tables):
    """Events as comments with Korean text, quotes, line ends and outer blanks in the cells."""
    return _events_as_comments(t).filter(F.col("press_name").isNotNull() & F.col("date").isNotNull()).withColumn(
        "comments", F.concat(F.lit("  \ub313\uae00 \"q\", "), "comments", F.lit("\n\ub05d ")))


_RAW_SQL = """
SELECT event_type AS press_name, strftime(ts, '%Y-%m-%d') AS date, CAST(user_id AS VARCHAR) AS user_nickname,
       '  \ub313\uae00 "q", ' || props || chr(10) || '\ub05d ' AS comments, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS regTime, event_id AS sympathyCount
FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL AND props IS NOT NULL"""


@register("press_tree_raw", jobs=("J1",), ids=("A1", "A2", "A5", "B21", "G1"), sql=_RAW_SQL + " AND strftime(ts, '%Y-%m') = '2024-01'")
def press_tree_raw(spark: SparkSession, sf_dir: str):
    """The raw layout in two encodings and two column orders, read by name for one month."""
    from pressroom.session import scratch_path
    root = scratch_path(spark, "raw-tree")
    _write_raw_tree(_raw_comments(Tables(spark, sf_dir)).filter(F.col("comments").isNotNull()), root)
    rows, _ = press_tree.ingest_press_tree(spark, root, months=["2024-01"], with_title=True, extra_columns=False)
    return rows.filter(F.col("title").rlike("^t[0-9]+n[0-9]+$")).select("press_name", "date", "user_nickname", "comments", "regTime", "sympathyCount")


@register("raw_tree_files", jobs=("J1",), ids=("D14", "A3", "A1"), sql="""
SELECT event_type AS press_name, count(*) AS n_rows, true AS all_listed FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL AND props IS NOT NULL GROUP BY 1
""")
def raw_tree_files(spark: SparkSession, sf_dir: str):
    """Files per press of the raw tree against the files that its rows name; one press is also read
    as a single table with an encoding fallback (A3) and must give the same rows."""
    from pressroom.session import scratch_path
    root = scratch_path(spark, "raw-tree")
    _write_raw_tree(_raw_comments(Tables(spark, sf_dir)).filter(F.col("comments").isNotNull()), root)
    rows, _ = press_tree.ingest_press_tree(spark, root, extra_columns=False)
    table = press_tree.read_csv_table(spark, f"{root}/*/*.csv", encodings=("utf-8", "cp949"))
    both = rows.select("press_name", "file_name", F.lit(1).alias("tree"), F.lit(0).alias("single")).unionByName(
        table.select(F.lit(None).cast("string").alias("press_name"), F.lit(None).cast("string").alias("file_name"), F.lit(0).alias("tree"), F.lit(1).alias("single")))
    per_press = both.groupBy("press_name").agg(F.sum("tree").alias("n_rows"), F.sum("single").alias("n_single"), F.countDistinct("file_name").alias("n_files"))
    # over one row per press
    everything = Window.partitionBy()
    per_press = per_press.withColumn("same", F.sum("n_rows").over(everything) == F.sum("n_single").over(everything))
    listed = (load_files(spark, "binaryFile", f"{root}/*/*.csv").select(F.element_at(F.split("path", "/"), -2).alias("press_name"))
              .groupBy("press_name").agg(F.count("*").alias("n_listed")))
    return per_press.join(listed, "press_name").select("press_name", "n_rows", ((F.col("n_files") == F.col("n_listed")) & F.col("same")).alias("all_listed"))


# More queries register themselves.
from pressroom.plans import catalog_files, catalog_web  # noqa: E402, F401

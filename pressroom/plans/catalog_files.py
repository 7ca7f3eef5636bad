"""Registered queries of the file jobs: one merged CSV file, press tables, tables of wanted folders; box-plot points, a plug-in tokenizer."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from pressroom.operators import boxstats, scores, tokens
from pressroom.plans.catalog import _DATED_FILE_SQL, _RAW_SQL, _dated_files, _events_as_comments, _length_scorer, _raw_comments, _tokens_sql
from pressroom.plans.registry import register
from pressroom.plans.standins import DOC_TEXTS_SQL, doc_texts
from pressroom.session import cut_lineage, scratch_path
from pressroom.sources import press_tree, sink, split_csv
from pressroom.sources.tables import Tables

MERGED = ["press_name", "date", "user_nickname", "comments", "regTime", "sympathyCount"]


def _merged(spark: SparkSession, sf_dir: str) -> str:
    """The raw comments as one file, in the order of press, date and number."""
    rows = _raw_comments(Tables(spark, sf_dir)).filter(F.col("comments").isNotNull()).select(*MERGED)
    path = f"{scratch_path(spark, 'integrated')}/integrated_csv.csv"
    sink.write_merged_csv(rows, path, ["press_name", "date", "sympathyCount"])
    return path


@register("merged_csv_roundtrip", jobs=("J1", "J2"), ids=("A9", "A4", "A1"), sql=f"""
SELECT row_number() OVER (ORDER BY press_name, date, "sympathyCount") AS record, * FROM ({_RAW_SQL}) AS r
""")
def merged_csv_roundtrip(spark: SparkSession, sf_dir: str):
    """All comments written as one CSV file, whose cells hold quotes and line ends, and read back by
    ranges: a record's number is its place in the file."""
    files = split_csv.CsvFiles(spark, _merged(spark, sf_dir))
    read = files.records(files.names())
    return read.select("record", *[F.col(c) for c in MERGED[:-1]], F.col("sympathyCount").cast("long").alias("sympathyCount"))


@register("merged_csv_by_press", jobs=("J1", "J12"), ids=("A4", "A3", "D14"), sql=f"""
SELECT press_name, count(*) AS n_comments, count(DISTINCT date) AS n_days, CAST(sum(length(comments)) AS BIGINT) AS n_chars FROM ({_RAW_SQL}) AS r GROUP BY 1
""")
def merged_csv_by_press(spark: SparkSession, sf_dir: str):
    """The merged file as the one table that the analyses start from."""
    table = press_tree.read_csv_table(spark, _merged(spark, sf_dir), encodings=("utf-8", "cp949"), na_tokens=())
    return table.groupBy("press_name").agg(F.count("*").alias("n_comments"), F.countDistinct("date").alias("n_days"),
                                           F.sum(F.length("comments")).alias("n_chars"))


_SCORED_SQL = f"""l AS (SELECT source AS press_name, {_DATED_FILE_SQL} AS f, unnest(string_split(text, chr(10))) AS c FROM documents WHERE source IS NOT NULL),
s AS (SELECT press_name, f, count(c) FILTER (WHERE regexp_matches(c, '\\S')) AS n, sum(length(c)) FILTER (WHERE regexp_matches(c, '\\S')) AS chars FROM l GROUP BY 1, 2)"""


@register("rescored_press", jobs=("J17",), ids=("A8",), sql=f"""
WITH {_SCORED_SQL},
r AS (SELECT press_name, f[1:10] AS "year-month-day", CASE WHEN n > 0 THEN round(chars / n, 6) END AS length FROM s
      WHERE f < '2024-07' OR press_name = (SELECT min(source) FROM documents)),
p AS (SELECT DISTINCT source AS press_name FROM documents WHERE source IS NOT NULL UNION SELECT 'press without comments')
SELECT press_name, "year-month-day", length FROM p LEFT JOIN r USING (press_name)
""")
def rescored_press(spark: SparkSession, sf_dir: str):
    """All presses scored for the first half of the year, then one press for the whole year: the others
    stay, the one is replaced, and presses without comments keep their empty tables."""
    t = Tables(spark, sf_dir)
    files = _dated_files(t)
    presses = cut_lineage(t.documents.select(F.col("source").alias("press_name")).filter("press_name IS NOT NULL").distinct())
    one = presses.agg(F.min("press_name").alias("press_name"))
    root = scratch_path(spark, "press-tables")

    def score(comments, listed):
        scored = scores.mean_scores(comments, scores.pandas_scorer(_length_scorer, ["length"]), scope="file")
        sink.write_press_tables(scores.score_table(scored, ["length"]), root, listed)

    nobody = spark.range(1).select(F.lit("press without comments").alias("press_name"))
    score(files.filter(F.col("month") < "2024-07"), presses.unionByName(nobody))
    score(files.join(one, "press_name", "left_semi"), one)
    rows, kept = sink.read_press_tables(spark, root)
    return kept.join(rows, "press_name", "left").select("press_name", "year-month-day", "length")


@register("mean_scores_day", jobs=("J17",), ids=("D8", "B19"), sql=f"""
WITH {_SCORED_SQL}
SELECT press_name, f[1:7] AS month, f[1:10] AS day, CAST(sum(n) AS BIGINT) AS n_comments, CASE WHEN sum(n) > 0 THEN round(sum(chars) / sum(n), 6) END AS length
FROM s GROUP BY 1, 2, 3
""")
def mean_scores_day(spark: SparkSession, sf_dir: str):
    """Mean scores of every press and day, over all its articles of the day."""
    files = _dated_files(Tables(spark, sf_dir)).withColumn("day", F.substring("file_name", 1, 10))
    return scores.mean_scores(files, scores.pandas_scorer(_length_scorer, ["length"]), day="day", scope="day")


@register("listed_months", jobs=("J9",), ids=("A5", "B1"), sql="""
WITH e AS (SELECT event_type AS press_name, strftime(ts, '%Y-%m') AS month, event_id FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL),
m AS (SELECT press_name, month, dense_rank() OVER (PARTITION BY press_name ORDER BY month DESC) AS place FROM (SELECT DISTINCT press_name, month FROM e))
SELECT e.* FROM e JOIN m USING (press_name, month) WHERE place <= 1
""")
def listed_months(spark: SparkSession, sf_dir: str):
    """The comments of every press's latest month, found by a table of presses and months: only the
    folders that it names are read."""
    rows = _events_as_comments(Tables(spark, sf_dir)).filter("press_name IS NOT NULL AND date IS NOT NULL")
    rows = rows.select("press_name", F.substring("date", 1, 7).alias("month"), F.col("sympathyCount").alias("event_id"))
    root = scratch_path(spark, "by-month")
    sink.write_table(rows, root, partition_by=["press_name", "month"])
    # one row per folder
    months = cut_lineage(rows.select("press_name", "month").distinct())
    place = F.dense_rank().over(Window.partitionBy("press_name").orderBy(F.desc("month")))
    listed = cut_lineage(months.withColumn("place", place)).filter("place <= 1")
    found = sink.read_listed(spark, root, listed, {"press_name": "press_name", "month": "month"})
    return found.select("press_name", "month", "event_id")


@register("length_outliers", jobs=("J16",), ids=("D4", "B12"), sql="""
WITH v AS (SELECT source, length(text) AS v FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
q AS (SELECT source, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM v GROUP BY 1)
SELECT source AS press_name, 'comment_length' AS metric, CAST(v AS DOUBLE) AS value, count(*) AS n
FROM v JOIN q USING (source) WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) GROUP BY 1, 2, 3
""")
def length_outliers(spark: SparkSession, sf_dir: str):
    """The points beyond the whiskers of every press's box of comment lengths."""
    rows = Tables(spark, sf_dir).documents.select(F.col("source").alias("press_name"), F.length("text").alias("comment_length"))
    return boxstats.outliers(rows, "press_name", ["comment_length"])


def _split_at_blanks(texts):
    """A stand-in for a noun analyser: texts in, token lists out."""
    return texts.map(lambda t: t.split(" "))


@register("top_tokens_plugin", jobs=("J18",), ids=("U1", "U3", "D6"), sql=f"WITH {DOC_TEXTS_SQL}, " + _tokens_sql("lang", "doc_texts", 10).replace(
    "GCOL", "lang").replace("regexp_extract_all(coalesce(comments, ''), '\\p{L}+')", "string_split(coalesce(comments, ''), ' ')"))
def top_tokens_plugin(spark: SparkSession, sf_dir: str):
    """Keywords by a tokenizer of the caller's, in slices of Arrow batches."""
    tokenizer = tokens.pandas_tokenizer(_split_at_blanks)
    return tokens.top_tokens(doc_texts(Tables(spark, sf_dir)), "lang", n=10, tokenizer=tokenizer)

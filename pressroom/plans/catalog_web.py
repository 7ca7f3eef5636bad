"""Registered queries of pages and urls as parsers read them, and of streams with state and counts."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pressroom.plans.catalog import _KEYED_EVENTS_SQL, _LINKS_SQL, _TITLE_RE, _keyed_events
from pressroom.plans.registry import register
from pressroom.session import cut_lineage, scratch_path
from pressroom.sources import links
from pressroom.sources.tables import Tables


@register("links_as_parsed", jobs=("J5",), ids=("A11", "C5"), sql=f"""
WITH {_LINKS_SQL}
SELECT * FROM l UNION ALL
SELECT page_id, CAST((SELECT count(*) FROM l WHERE l.page_id = pages.page_id) AS INTEGER), '/n?id=' || page_id || '&b=1', 'in ner deep 가 <b>' FROM pages
""")
def links_as_parsed(spark: SparkSession, sf_dir: str):
    """Anchors in comments, scripts and attribute values are none; one anchor with a bare attribute
    value, nested elements and references is read whole."""
    before = F.lit("<!-- <a href=\"/old\">old</a> --><script>document.write('<a href=\"/js\">js</a>')</script><img alt='<a href=\"/alt\">'>")
    after = F.concat(F.lit("<div><A class=\"x y\" title='a > b' HREF=/n?id="), F.col("page_id").cast("string"),
                     F.lit("&amp;b=1><b>bold</b><br><SPAN>in <i>ner <span>deep</span></i> &#44032; &#x3c;b&gt;</SPAN> out</div> behind"))
    pages = Tables(spark, sf_dir).pages.select("page_id", F.concat(before, "html", after).alias("html"))
    return links.extract_links(pages, "html", "page_id")


@register("lenient_query_value", jobs=("J5", "J6"), ids=("A12",), sql="""
SELECT page_id, CAST(page_id AS VARCHAR) || ' A%zz 가=3' AS press_id, '2|x' AS other, CAST(NULL AS VARCHAR) AS blank FROM pages
""")
def lenient_query_value(spark: SparkSession, sf_dir: str):
    """Query values of urls that a strict parser refuses: blanks, bars, empty and repeated values,
    broken percent signs, a question mark in the fragment."""
    url = F.concat(F.lit("/main list?a|b=2|x&blank=&officeId&officeId=&%6FfficeId="), F.col("page_id").cast("string"),
                   F.lit("+%41%zz%20%EA%B0%80=3&officeId=9#x?officeId=8"))
    p = Tables(spark, sf_dir).pages
    return p.select("page_id", links.query_value(url, "officeId").alias("press_id"), links.query_value(url, "a|b").alias("other"),
                    links.query_value(url, "blank").alias("blank"))


@register("quoted_titles", jobs=("J5",), ids=("A11",), sql=f"""
WITH t AS (SELECT page_id, regexp_extract(html, '{_TITLE_RE}', 1) AS title FROM pages)
SELECT page_id, replace(url_encode(title), '%2F', '/') AS quoted, title AS back FROM t
""")
def quoted_titles(spark: SparkSession, sf_dir: str):
    """Titles as search phrases of a url, and read back from its query."""
    p = Tables(spark, sf_dir).pages.select("page_id", links.quote(F.regexp_extract("html", _TITLE_RE, 1)).alias("quoted"))
    back = F.coalesce(links.query_value(F.concat(F.lit("/search?ssc=tab&query="), "quoted", F.lit("&sm=1")), "query"), F.lit(""))
    return p.select("page_id", "quoted", back.alias("back"))


# ---------------------------------------------------------------- J24 with state and observed counts
# Three thirds of the time span, landed with the middle one first: the first third comes late.
_LANDED_SQL = f"""{_KEYED_EVENTS_SQL},
b AS (SELECT epoch_us(min(fetched)) AS lo, epoch_us(max(fetched)) AS hi FROM k),
p AS (SELECT k.*, CASE WHEN epoch_us(fetched) <= lo + (hi - lo) // 3 THEN 1 WHEN epoch_us(fetched) <= lo + (hi - lo) // 3 * 2 THEN 0 ELSE 2 END AS batch FROM k, b),
f AS (SELECT user_id, press_name, arg_min(fetched, batch * 10000000000000000 + epoch_us(fetched)) AS first FROM p GROUP BY 1, 2),
r AS (SELECT p.* FROM p JOIN f ON p.user_id IS NOT DISTINCT FROM f.user_id AND p.press_name IS NOT DISTINCT FROM f.press_name AND p.fetched = f.first)"""


def _landed_in_thirds(spark: SparkSession, sf_dir: str):
    """The keyed fetches, their schema, and the number of the batch that each lands in."""
    rows = _keyed_events(Tables(spark, sf_dir))
    micros = F.unix_micros(F.col("fetched").cast("timestamp"))
    lo, hi = rows.agg(F.min(micros), F.max(micros)).first()
    third = ((hi or 0) - (lo or 0)) // 3
    batch = F.when(micros <= F.lit((lo or 0) + third), 1).when(micros <= F.lit((lo or 0) + 2 * third), 0).otherwise(2)
    return cut_lineage(rows.withColumn("batch", batch)), rows.schema


@register("stream_keyed_first", jobs=("J24",), ids=("S1", "G5", "C2"), sql=f"""
WITH {_LANDED_SQL}
SELECT event_id, user_id, press_name, fetched FROM r
""")
def stream_keyed_first(spark: SparkSession, sf_dir: str):
    """Keys remembered by the stream: three batches, each a restart from the checkpoint, with late
    fetches and repeated keys. The first batch that brings a key wins."""
    from pressroom.streaming import keyed
    base = scratch_path(spark, "keyed")
    dealt, schema = _landed_in_thirds(spark, sf_dir)
    for batch in range(3):
        dealt.filter(F.col("batch") == batch).drop("batch").write.mode("append").parquet(f"{base}/landed")
        keyed.stream_keyed(spark, f"{base}/landed", f"{base}/sink", f"{base}/checkpoint", schema, ["user_id", "press_name"], "fetched", glob_filter="*.parquet")
    return spark.read.schema(schema).parquet(f"{base}/sink").select("event_id", "user_id", "press_name", "fetched")


@register("stream_batch_counts", jobs=("J24", "J8"), ids=("S1", "D13", "A10"), sql=f"""
WITH {_LANDED_SQL},
i AS (SELECT batch, count(*) AS n_input FROM p GROUP BY 1), w AS (SELECT batch, count(*) AS n_written FROM r GROUP BY 1)
SELECT source, CAST(i.batch AS BIGINT) AS batch_id, n_input, coalesce(n_written, 0) AS n_written
FROM i LEFT JOIN w USING (batch) CROSS JOIN (VALUES ('keyed'), ('sink')) AS s(source)
""")
def stream_batch_counts(spark: SparkSession, sf_dir: str):
    """Rows in and rows written of every batch, as metrics observed while the batches run: of the keyed
    stream by its progress, of the sink's anti-join by its own actions."""
    from pressroom.streaming import ingest, keyed
    base = scratch_path(spark, "counts")
    dealt, schema = _landed_in_thirds(spark, sf_dir)
    key = ["user_id", "press_name"]
    for batch in range(3):
        dealt.filter(F.col("batch") == batch).drop("batch").write.mode("append").parquet(f"{base}/landed")
        keyed.stream_keyed(spark, f"{base}/landed", f"{base}/keyed", f"{base}/c1", schema, key, "fetched", audit=f"{base}/audit-keyed", glob_filter="*.parquet")
        ingest.stream_ingest(spark, f"{base}/landed", f"{base}/sink", f"{base}/c2", schema, key=key, order="fetched", partition_by=["press_name"],
                             audit=f"{base}/audit-sink", glob_filter="*.parquet")
    counts = [ingest.batch_audit(spark, f"{base}/audit-{s}").select(F.lit(s).alias("source"), "batch_id", "n_input", "n_written") for s in ("keyed", "sink")]
    return counts[0].unionByName(counts[1])

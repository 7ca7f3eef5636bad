"""J5 result-page links: html -> (page, pos, href, text) rows.

Pages go through the tokenizer of ``sources.html_tokens`` in Arrow batches, one pass over each text:
anchors inside comments or scripts are none, quoted and bare attributes, nested and unclosed elements
and character references are read as a parser reads them. Url and title always travel in the same row
(SURVEY T23). The link text is that of the first ``<span>`` inside the anchor when there is one, else
the anchor's. Row-local, no shuffle, unless ``distinct`` is asked for (then one aggregate keyed by
href keeps the first occurrence).

Urls are read as Python's ``urlparse`` and ``parse_qs`` read them, and written as its ``quote`` does,
in column expressions: whatever a url holds, no row fails.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from pressroom.sources.html_tokens import anchors

# Patterns for well-formed anchors, as the queries' SQL uses them.
SPAN = r"(?is)<span[^>]*>(.*?)</span\s*>"
TAG = r"<[^>]*>"
# Character references that attribute values and texts hold, ampersand last.
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def decode_references(c: Column) -> Column:
    for name, char in REFERENCES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def extract_links(df: DataFrame, html: str = "html", key: str = "page_id", contains: str | None = None,
                  distinct: bool = False, css_class: str | None = None) -> DataFrame:
    """``css_class``: keep only anchors whose ``class`` attribute lists all the classes named
    there (one or several, in any order, A11). ``pos`` counts the anchors with a ``href``;
    a null page has none."""
    fields = [df.schema[key], StructField("pos", IntegerType()), StructField("href", StringType()), StructField("text", StringType())]
    wanted = set(css_class.split()) if css_class is not None else set()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages, places, hrefs, texts = [], [], [], []
            for i, page in enumerate(batch.column(html)):
                for pos, (href, classes, text) in enumerate(anchors(page.as_py() or "")):
                    if not wanted or wanted.issubset(classes.split()):
                        pages.append(i)
                        places.append(pos)
                        hrefs.append(href)
                        texts.append(text)
            columns = [batch.column(key).take(pa.array(pages, pa.int64())), pa.array(places, pa.int32()), pa.array(hrefs, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    out = df.select(key, html).mapInArrow(read, StructType(fields))
    if contains is not None:
        out = out.filter(F.col("href").contains(contains))
    if distinct:
        # First occurrence (by key, pos) of each href; partial aggregation per task.
        first = F.min_by(F.struct(key, "pos", "text"), F.struct(key, "pos"))
        out = out.groupBy("href").agg(first.alias("f")).select("f." + key, "f.pos", "href", "f.text")
    return out


def unquote(c: Column) -> Column:
    """``unquote_plus``: ``+`` is a blank, ``%XX`` a byte of UTF-8, any other ``%`` stands for itself."""
    return F.url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def quote(c: Column, safe: str = "/") -> Column:
    """``quote``: all but letters, digits, ``_.-~`` and the characters of ``safe`` as ``%XX`` of UTF-8."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for char in "*" + "~" + safe:
        code = f"%{ord(char):02X}"
        kept = char in safe or char == "~"
        # the encoder of forms leaves * and writes ~ as a code
        out = F.replace(out, F.lit(code), F.lit(char)) if kept else F.replace(out, F.lit(char), F.lit(code))
    return out


def query_pairs(url: Column) -> Column:
    """Array of (name, value) of a url's query, decoded, in order: ``parse_qsl`` -- pairs without
    ``=`` or with an empty value are dropped. No query: empty."""
    query = F.regexp_extract(url, r"(?s)^[^#?]*\?([^#]*)", 1)
    parts = F.filter(F.split(query, "&"), lambda p: p.rlike("(?s)^[^=]*=."))
    return F.transform(parts, lambda p: F.struct(
        unquote(F.regexp_extract(p, "(?s)^([^=]*)=", 1)).alias("name"), unquote(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("value")))


def query_value(url: Column, name: str) -> Column:
    """The first value of a query parameter, as ``parse_qs(urlparse(url).query)[name][0]``; null
    where there is none. Character references are decoded first, a raw attribute value may be given."""
    return F.get(F.filter(query_pairs(decode_references(url)), lambda p: p["name"] == name), 0)["value"]


def press_directory(links: DataFrame, param: str = "officeId", out_id: str = "press_id",
                    out_name: str = "press_name") -> DataFrame:
    """Press directory from extracted links -- id = the ``param`` query value of the
    href, name = the link text; one row per id (first link by page and position). The
    result feeds ``operators.articles.lookup_press``."""
    rows = (links.select(query_value(F.col("href"), param).alias(out_id), F.col("text").alias(out_name),
                         F.struct(*[c for c in links.columns if c not in ("href", "text")]).alias("_o"))
                 .filter(F.col(out_id).isNotNull()))
    return rows.groupBy(out_id).agg(F.min_by(out_name, "_o").alias(out_name))

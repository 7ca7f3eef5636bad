"""How the driver tables stand in for the comment data model.

| comment notion            | driver table / column                                   |
|---------------------------|---------------------------------------------------------|
| press                     | documents.source                                        |
| comment text              | documents.text                                          |
| visible                   | labels.toxic = 0 (no label -> null)                     |
| regTime                   | events.ts (hours, weekdays), orders.o_orderdate (months) |
| sympathy / antipathy      | events.value, lineitem.l_quantity                        |

Each builder has a SQL twin (``*_SQL``) used by the oracles, so both sides start from the
same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressroom.sources.tables import Tables, spread


def doc_comments(t: Tables) -> DataFrame:
    """documents LEFT JOIN labels -> one comment per document."""
    d = t.documents.select("doc_id", F.col("source").alias("press_name"),
                           F.col("text").alias("comments"), "lang")
    lab = t.labels.select("doc_id", (F.col("toxic") == 0).alias("visible"), "quality")
    return d.join(lab, "doc_id", "left")


DOC_COMMENTS_SQL = """
doc_comments AS (
  SELECT d.doc_id, d.source AS press_name, d.text AS comments, d.lang,
         l.toxic = 0 AS visible, l.quality
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""


def doc_texts(t: Tables, text_heavy: bool = True) -> DataFrame:
    """Text-only view of the documents (no label join). ``text_heavy`` jobs (regex over the
    whole texts) deal the texts out evenly; others read the scan as is."""
    d = spread(t.documents, "doc_id") if text_heavy else t.documents
    return d.select("doc_id", F.col("source").alias("press_name"), F.col("text").alias("comments"), "lang")


DOC_TEXTS_SQL = """
doc_texts AS (SELECT doc_id, source AS press_name, text AS comments, lang FROM documents)"""
